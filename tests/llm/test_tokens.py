"""BPE, packing and token files against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from depthkit.llm import bpe, packing, tokenfile
from depthkit.llm.base import text_slices
from depthkit.session import scratch_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PIECES = ["the", "Été", "’s", "'s", "'LL", "'", "''", " ", "  ", "\n", "\n\n", "\t", "123", "½", "!!?", "<|endoftext|>", "<|", "日本", "é",
          "ß", "a", "aaaa", " ", "\x00", "_x", "thinking", "unbelievable", "(x)"]


def texts(n=1500):
    rng = random.Random(3)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    out += ["".join(rng.choice("abcdeinrst'") for _ in range(rng.randint(1, 90))) for _ in range(n)]
    return out + ["", None, "a" * 3000, "ab" * 500, " " * 50, "x " * 4000, *colliding()]


def colliding():
    """Texts of two words that any polynomial modulo 2^64 with an odd base takes for equal."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    return [f"x {word} {other}", f"{other} {word}", word, other]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_library(name):
    path = public_tokenizers.path(name)
    library, v, all_texts = Tokenizer.from_file(path), bpe.Vocabulary(path), texts()
    for lo, hi, data, offs in text_slices(pa.array(all_texts), 20_000):
        flat, counts = v.encode_slice(data, offs)
        ends = np.cumsum(counts)
        for k, (end, n) in enumerate(zip(ends, counts)):
            want = library.encode(all_texts[lo + k] or "", add_special_tokens=False).ids
            assert flat[end - n:end].tolist() == want
            assert v.decode(want).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_verification_rejects_what_greedy_gets_wrong(name):
    v = bpe.Vocabulary(public_tokenizers.path(name))
    words = [w.encode() for w in {"".join(random.Random(i).choices("etaoinsrh", k=7)) for i in range(400)}]
    data, n = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ends = np.cumsum(n)
    greedy, sizes = v.speculate(data, ends - n, ends)
    exact, counts = v.encode_pieces(data, ends - n, ends)
    greedy = [x.tolist() for x in np.split(greedy, np.cumsum(sizes)[:-1])]
    exact = [x.tolist() for x in np.split(exact, np.cumsum(counts)[:-1])]
    assert exact == [v.merge_long(w) for w in words]
    assert any(g != x for g, x in zip(greedy, exact)) and any(g == x for g, x in zip(greedy, exact))


def test_a_full_memo_is_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 64)
    path = public_tokenizers.path(FILES[0])
    v, library = bpe.Vocabulary(path), Tokenizer.from_file(path)
    text = " ".join("".join(random.Random(i).choices("abcde", k=5)) for i in range(500))
    data = np.frombuffer(text.encode(), np.uint8)
    assert v.encode_slice(data, np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def test_round_trip_and_arrays(spark):
    rows = [(1, "Hello  world's"), (1, "Hello  world's"), (None, "x"), (3, None), (4, "")]
    path = public_tokenizers.path(FILES[0])
    got = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(frame(spark, rows), path).collect()}
    n = len(Tokenizer.from_file(path).encode(rows[0][1], add_special_tokens=False).ids)
    assert got == {(1, n), (None, 1), (3, 0), (4, 0)}
    ids = bpe.encode(frame(spark, rows), path)
    assert {r.text for r in bpe.decode(ids, path).collect()} == {"hello</w> world</w> 's</w>", "x</w>", ""}
    assert bpe.round_trip(frame(spark, []), path).count() == 0


def test_packing_covers_every_id_once(spark):
    path = public_tokenizers.path(FILES[0])
    rows = [(i, "word " * (i * 7 % 40) + "end") for i in range(60)] + [(100, None), (101, ""), (102, "long " * 900), (5, "again"), (None, "null id")]
    rows += [(110 + i, t) for i, t in enumerate(colliding())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, ids string").repartition(5)
    out = packing.pack(df, path, length=64, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    seqs = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id, r.start, r.doc_tokens, ids.tolist()))
    for k, parts in seqs.items():
        at = 0
        for p in sorted(parts):
            assert p[0] == at
            at += p[1]
        assert at == 64 or k == max(seqs)
    flat = [p for k in sorted(seqs) for p in sorted(seqs[k])]
    docs, at = [], None
    for p in flat:  # pieces of one document follow each other in the row of ids
        if p[3] == 0:
            docs.append([])
        docs[-1] += p[5]
    assert sorted(docs) == want
    assert packing.pack(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("counts", [[], [5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128, 256, 512], [3] * 17, [10 ** 9, 1, 1, 1, 0, 5]])
@pytest.mark.parametrize("limit", [5, 12])
def test_code_is_canonical_limited_and_decodable(counts, limit):
    lengths = tokenfile.code_lengths(np.array(counts, np.int64), limit)
    used = np.flatnonzero(lengths)
    assert used.tolist() == np.flatnonzero(counts).tolist() and (lengths <= limit).all()
    assert sum(2.0 ** -lengths[used]) <= 1
    codes = tokenfile.canonical(lengths)
    words = [format(int(codes[s]), f"0{lengths[s]}b") for s in used]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    if len(used):
        ids = np.random.default_rng(1).choice(used, 1000).astype(np.uint16)
        bits, marks = tokenfile.encode_block(ids, codes, lengths)
        symbols, sizes = tokenfile.decode_table(lengths, limit)
        assert (tokenfile.decode_block(bits, marks, len(ids), symbols, sizes, limit) == ids).all()


def test_code_length_matches_huffman_where_the_limit_does_not_bind():
    lengths = tokenfile.code_lengths(np.array([45, 13, 12, 16, 9, 5]), 18)
    assert sorted(lengths.tolist()) == [1, 3, 3, 3, 4, 4]


@pytest.mark.parametrize("block", [50, 1 << 17])
def test_token_files(spark, block):
    path = public_tokenizers.path(FILES[1])
    rows = [(i, f"text {i} " * (i % 9)) for i in range(80, 0, -1)] + [(200, "very long " * 400), (201, None), (202, "")]
    rows += [(300 + i, t) for i, t in enumerate(colliding())]
    folder = scratch_path(spark, "test-tokenfile")
    tokenfile.write(frame(spark, rows).repartition(4), path, folder, block=block)
    got = {r.doc_id: r for r in tokenfile.digests(tokenfile.read_tokens(spark, folder)).collect()}
    library, at = Tokenizer.from_file(path), 0
    for d, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), bpe.crc_of(np.array(ids)))
        at += len(ids)
    assert len(got) == len(rows)


def test_token_files_of_an_empty_table(spark):
    assert tokenfile.round_trip(frame(spark, []), public_tokenizers.path(FILES[1])).count() == 0
