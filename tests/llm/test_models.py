"""The language field and the toxicity network: gradients, brute force and held-out accuracy."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthkit.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lens = np.array([1, 4, 2, 5])
    score, move, start = rng.normal(size=(lens.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, pairs = langid.forward_backward(score, lens, move, start, True)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in lens:
        own, joint, total = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(score[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                own[i, y] += w
            for a, b in zip(path, path[1:]):
                joint[a, b] += w
        assert np.allclose(got[at:at + n], own / total)
        want_pairs += joint / total
        at += n
    assert np.allclose(pairs, want_pairs)


WORDS = {"en": "the and of with that have from this would there".split(), "de": "der und mit dass haben von diese würde dort nicht".split(),
         "fr": "le et de avec que avoir cette serait là pas".split()}


def sentences(lang, n, rng):
    suffix = {"en": ["ing", "tion"], "de": ["ung", "keit"], "fr": ["eaux", "ment"]}[lang]
    return [rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choices("abdefgilmnoprst", k=4)) + rng.choice(suffix) for _ in range(n)]


def test_code_switched_words_are_labelled():
    rng = random.Random(1)
    spans = [(l, sentences(l, 20, rng)) for l in WORDS for _ in range(150)]
    model = langid.train(spans)
    right = total = 0
    for _ in range(30):
        a, b = rng.sample(sorted(WORDS), 2)
        words = sentences(a, 8, rng) + sentences(b, 8, rng)
        data, s, e, lens = langid._flat([words])
        p = langid.posteriors(model, langid.emissions(model, *langid.word_features(data, s, e)), lens)
        gold = [model.labels.index(a)] * 8 + [model.labels.index(b)] * 8
        right, total = right + int((p.argmax(1) == gold).sum()), total + 16
    assert right / total > 0.9
    assert all(model.move[i, i] > model.move[i, j] for i in range(3) for j in range(3) if i != j)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(sentences(l, 30, rng)), l) for i, l in enumerate(["en", "de"] * 60)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !? \n", None), (None, "der und mit dass", None), (903, "word " * 5000, "en"), (903, "der " * 50, None), (904, "日本語", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df).collect()}
    assert {(900, "und"), (901, "und"), (902, "und"), (None, "de"), (903, "de")} <= got and all(l in ("en", "de", "und") for _, l in got)
    assert not any(d == 904 and l == "und" for d, l in got)
    empty = langid.identify(df.limit(0))
    assert empty.count() == 0
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    p = toxicity.new_params(np.zeros(0, np.uint64))
    for k in list(p):
        p[k] = p[k].astype(np.float64) if p[k].dtype == np.float32 else p[k]
    x = rng.normal(size=(5, 3, p["wfx"].shape[0]))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    up = rng.normal(size=(3, p["wa"].shape[0]))
    f = lambda: float((toxicity.bigru_pool(p, "w", x, mask) * up).sum())
    _, saved = toxicity.bigru_pool(p, "w", x, mask, True)
    grads = {}
    dx = toxicity.bigru_pool_back(p, "w", up, saved, grads)
    for name, g in [*grads.items(), ("x", dx)]:
        value = x if name == "x" else p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-2
            high = f()
            value[at] = old - 1e-2
            low = f()
            value[at] = old
            assert abs((high - low) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at])), name


def test_states_of_scoring_equal_the_network():
    """Rows by length, in blocks and gate by gate: the same as the network that is trained."""
    rng = np.random.default_rng(4)
    p = toxicity.new_params(np.zeros(0, np.uint64))
    table = rng.normal(size=(300, p["wfx"].shape[0])).astype(np.float32)
    count = np.sort(rng.integers(1, 33, 2 * toxicity.BLOCK + 77))
    place = rng.integers(0, 300, (32, len(count)))
    want = toxicity.bigru_pool(p, "w", table[place], np.arange(32)[:, None] < count)
    got = toxicity.pool_sorted(p, "w", toxicity.gates(p, "wf", table), toxicity.gates(p, "wb", table), place, count)
    assert got.shape == want.shape and np.allclose(got, want, rtol=1e-5, atol=1e-6)


def test_scoring_keeps_no_steps():
    """A scored window's steps are not kept: 2,048 windows took 39 MB, in arrays too large to be used again."""
    rng = np.random.default_rng(5)
    p = toxicity.new_params(np.zeros(0, np.uint64))
    words = rng.normal(size=(500, p["wfx"].shape[0])).astype(np.float32)
    ids = rng.integers(0, 500, 2048 + 32)
    tracemalloc.start()
    toxicity.window_logits(p, words, ids, np.arange(2048), np.full(2048, 32))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16e6, most


def test_windows_cover_all_words():
    n = np.array([0, 1, 31, 32, 33, 100, 1000])
    row, first, count = toxicity.window_words(n)
    begin = np.cumsum(n) - n
    for r, k in enumerate(n):
        some = row == r
        covered = sorted({int(f) + i for f, c in zip(first[some], count[some]) for i in range(c)})
        assert covered == list(range(begin[r], begin[r] + k))
        assert k <= toxicity.WINDOW or (np.diff(first[some]) == toxicity.STEP).all()


def test_every_byte_of_a_long_run_is_read():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abé日😀", k=rng.randint(1, 40))) for _ in range(300)] + ["", "a" * 10, "b" * 11, "日" * 500]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    low, s, e, row = toxicity.pieces(data, offs)
    assert (e - s <= toxicity.BYTES).all() and (e > s).all()
    covered = np.zeros(len(data), bool)
    for a, b, r in zip(s, e, row):
        assert offs[r] <= a and b <= offs[r + 1]
        low[a:b].tobytes().decode()  # whole characters
        covered[a:b] = True
    assert covered.all()


def test_toxic_stems_inside_long_runs_are_found():
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeionrst", k=rng.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(800):
        some = rng.choices(plain, k=rng.randint(30, 100))
        for _ in range(rng.randint(2, 5) * (i % 4 == 0)):
            some[rng.randrange(len(some))] = rng.choice(["grumbog", "skarnish", "grumbolt", "skarnled"])
        rows.append((int(i % 4 == 0), " ".join(some)))
    p = toxicity.train(rows)
    some = rng.choices(plain, k=60)
    clean = " ".join(some)
    glued = " ".join(some[:30] + ["".join(some[:3]) + "grumbog" + "".join(some[3:6])] + some[30:])
    wide = "日本語" * 20 + "grumbogskarnish" + "日本語" * 20
    raw = [t.encode() for t in (clean, glued, wide)]
    score, windows = toxicity.score_slice(p, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert score[0] < 0.5 <= min(score[1], score[2]) and windows[2] > 1


def test_toxic_words_are_found_wherever_they_are(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeionrst", k=rng.randint(2, 7))) for _ in range(500)]
    rude = ["grumbog", "skarnish", "grumbolt", "skarnled"]

    def text(toxic):
        words = rng.choices(plain, k=rng.randint(30, 150))
        for _ in range(rng.randint(2, 5) * toxic):
            words[rng.randrange(len(words))] = rng.choice(rude)
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    long = rng.choices(plain, k=3000)
    long[2900] = long[2905] = "grumbog"
    odd = [(5000, " ".join(long)), (5001, None), (5002, ""), (5003, "12 !"), (None, "grumbog skarnish"), (5004, text(False))]
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7777, 1), (1, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.93 and all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert out[5000].predicted == 1 and out[5001].score == out[5002].score == out[5003].score == 0 and out[None].predicted == 1
    left = toxicity.keep_clean(docs.withColumn("score", F.lit(1)), labels)
    kept = {r.doc_id for r in left.collect()}
    assert 5000 not in kept and {5001, 5002, 5003} <= kept and left.columns == ["doc_id", "text", "score"]
    none = toxicity.score(docs, labels.limit(0))
    assert none.where("predicted = 1").count() == 0 and toxicity.score(docs.limit(0), labels).count() == 0
