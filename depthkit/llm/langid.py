"""Language identification by a linear-chain conditional random field (op 6).

The words of a line form a chain whose hidden labels are languages, so code-switched text gets
labels that change within a line.  Emissions come from hashed features of a word: prefixes
and suffixes (one to four bytes), the word's byte trigrams, the word itself, and lexicon
membership (frequent words of each language in the sample).  Transitions are learned with
them, by gradient steps on the likelihood, with expectations from forward-backward.

A text's score for a language is the mean posterior of its words; the best one wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import WIDE_SLICE, labelled_sample, letter_words, mix, prefix_sums, ragged, raw_hash, ship, text_slices

#: Bounds of the training sample: rows of a language, spans cut from a row, words of a span.
SAMPLE_ROWS, SAMPLE_SPANS, SPAN = 400, 4, 24
#: Frequent words of the sample that make a language's lexicon.
LEXICON = 500
BUCKETS = 1 << 16
_U = np.uint64


@dataclass
class Model:
    labels: list[str]
    emit: np.ndarray  # buckets x labels
    lexicon: np.ndarray  # sorted word hashes
    lexicon_of: np.ndarray  # membership, words x labels
    lexicon_weight: np.ndarray  # labels
    move: np.ndarray  # labels x labels
    start: np.ndarray


def word_features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, flat feature buckets, number of features of each word)."""
    sums = prefix_sums(data)
    n = e - s
    mask = _U(BUCKETS - 1)
    whole = mix(raw_hash(sums, s, e))
    flat, owner = [(mix(whole + _U(1)) & mask)], [np.arange(len(s))]
    for k in (1, 2, 3, 4):
        some = np.flatnonzero(n > k)
        flat += [mix(raw_hash(sums, s[some], s[some] + k) ^ _U(0x1000 + k)) & mask, mix(raw_hash(sums, e[some] - k, e[some]) ^ _U(0x2000 + k)) & mask]
        owner += [some, some]
    count = np.maximum(n - 2, 0)
    at = ragged(s, count)
    flat.append(mix(raw_hash(sums, at, at + 3) ^ _U(0x3000)) & mask)
    owner.append(np.repeat(np.arange(len(s)), count))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return whole, np.concatenate(flat)[order].astype(np.int64), np.bincount(owner, minlength=len(s))


def emissions(model: Model, whole: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Scores (words x labels): mean weight of a word's features, scaled, plus its lexicon entry."""
    if not len(whole):
        return np.zeros((0, len(model.labels)))
    first = np.cumsum(count) - count
    out = np.add.reduceat(model.emit[flat], first, axis=0) / np.sqrt(count)[:, None]
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, whole), len(model.lexicon) - 1)
        out = out + (model.lexicon_of[at] * model.lexicon_weight) * (model.lexicon[at] == whole)[:, None]
    return out


def posteriors(model: Model, score: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Forward-backward over chains of adjacent words (``lens`` words each): label probabilities.

    Chains are sorted by length, so each step handles all chains that are still going."""
    p, _ = forward_backward(score, lens, model.move, model.start, False)
    return p


def forward_backward(score, lens, move, start, pairs):
    labels = score.shape[1]
    order = np.argsort(-lens, kind="stable")
    long = lens[order]
    steps = int(long[0]) if len(long) else 0
    alive = np.searchsorted(-long, -np.arange(steps), "left")  # chains with more than t words
    base = np.concatenate([[0], np.cumsum(alive)])
    first = np.cumsum(lens) - lens
    place = np.empty(len(score), np.int64)  # packed row of each word
    chain_rank = np.empty(len(lens), np.int64)
    chain_rank[order] = np.arange(len(lens))
    step = ragged(np.zeros(len(lens), np.int64), lens)
    place = base[step] + np.repeat(chain_rank, lens)
    packed = np.empty_like(score)
    packed[place] = score
    packed = np.exp(packed - packed.max(1, keepdims=True)) if len(packed) else packed
    trans, init = np.exp(move - move.max()), np.exp(start - start.max())
    alpha, beta = np.empty_like(packed), np.ones_like(packed)
    for t in range(steps):
        a, b = base[t], base[t + 1]
        x = packed[a:b] * (init if t == 0 else alpha[base[t - 1]:base[t - 1] + b - a] @ trans)
        alpha[a:b] = x / x.sum(1, keepdims=True)
    total = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        a, k = base[t], alive[t + 1]
        ahead = packed[base[t + 1]:base[t + 2]] * beta[base[t + 1]:base[t + 2]]
        x = ahead @ trans.T
        if pairs:
            joint = alpha[a:a + k, :, None] * trans[None] * ahead[:, None, :]
            total += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[a:a + k] = x / x.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    return p[place], total


# ---- training --------------------------------------------------------------------------
def sample_spans(df: DataFrame, label: str, text: str, most: int, spans: int, span: int, key: str = "doc_id") -> list[tuple[str, list[str]]]:
    """(label, words) of spans spread evenly over whole texts of a bounded sample of labelled rows."""
    ship(df.sparkSession)
    rows = labelled_sample(df, label, most, key).select(F.col(label).cast("string").alias("l"), F.col(text).alias("t"))

    def run(batches):
        for batch in batches:
            l, w = [], []
            for lo, hi, data, offs in text_slices(batch.column(1), WIDE_SLICE):
                low, s, e, row = letter_words(data, offs)
                raw, cut = low.tobytes(), np.searchsorted(row, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    a, b = int(cut[r]), int(cut[r + 1])
                    k = min(spans, max(1, (b - a) // span))
                    for at in np.linspace(a, max(a, b - span), k).astype(int):
                        some = range(at, min(at + span, b))
                        if len(some) > 2:
                            l.append(batch.column(0)[lo + r].as_py())
                            w.append(" ".join(raw[s[i]:e[i]].decode("utf-8", "replace") for i in some))
            yield pa.RecordBatch.from_arrays([pa.array(l, pa.string()), pa.array(w, pa.string())], ["l", "w"])

    return sorted((r[0], r[1].split(" ")) for r in rows.mapInArrow(run, "l string, w string").collect())


def _flat(chains: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = [w.encode() for c in chains for w in c]
    n = np.array([len(w) for w in raw], np.int64)
    e = np.cumsum(n)
    return np.frombuffer(b"".join(raw), np.uint8), e - n, e, np.array([len(c) for c in chains], np.int64)


def train(spans: list[tuple[str, list[str]]], epochs: int = 6, rate: float = 0.4, seed: int = 3) -> Model:
    """Fit a model on labelled spans.  Half of the chains are spliced from two languages, so
    that transitions between languages are seen."""
    labels = sorted({l for l, _ in spans})
    k = len(labels)
    rng = np.random.default_rng(seed)
    counts: dict[str, np.ndarray] = {}
    for l, ws in spans:
        for w in ws:
            counts.setdefault(w, np.zeros(k))[labels.index(l)] += 1
    lex: dict[str, np.ndarray] = {}
    for j in range(k):
        for w, c in sorted(((w, c) for w, c in counts.items() if c[j] > 1), key=lambda x: (-x[1][j], x[0]))[:LEXICON]:
            lex.setdefault(w, np.zeros(k))[j] = 1
    data, s, e, _ = _flat([list(lex)])
    whole = word_features(data, s, e)[0] if lex else np.zeros(0, np.uint64)
    order = np.argsort(whole)
    members = np.array([lex[w] for w in lex]).reshape(-1, k)[order] if lex else np.zeros((0, k))
    model = Model(labels, np.zeros((BUCKETS, k)), whole[order], members, np.ones(k), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    squares = [np.full_like(x, 1e-2) for x in (model.emit, model.lexicon_weight, model.move, model.start)]
    for _ in range(epochs):
        mixed = [spans[i] for i in rng.permutation(len(spans))]
        chains, gold = [], []
        for i, (l, ws) in enumerate(mixed):
            y = [labels.index(l)] * len(ws)
            if i % 2 and i:
                l2, w2 = mixed[i - 1]
                cut = int(rng.integers(1, len(ws) + 1))
                y, ws = y[:cut] + [labels.index(l2)] * len(w2[cut:]), ws[:cut] + w2[cut:]
            chains.append(ws)
            gold.append(y)
        for at in range(0, len(chains), 64):
            part, y = chains[at:at + 64], np.concatenate(gold[at:at + 64])
            data, s, e, lens = _flat(part)
            whole, flat, count = word_features(data, s, e)
            score = emissions(model, whole, flat, count)
            p, joint = forward_backward(score, lens, model.move, model.start, True)
            grad = -p
            grad[np.arange(len(y)), y] += 1
            first = np.cumsum(lens) - lens
            inner = np.ones(len(y), bool)
            inner[first] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            owner = np.repeat(np.arange(len(count)), count)
            used, back = np.unique(flat, return_inverse=True)
            per = grad[owner] / np.sqrt(count[owner])[:, None]
            g_emit = np.stack([np.bincount(back, per[:, j], len(used)) for j in range(k)], 1)
            squares[0][used] += g_emit ** 2
            model.emit[used] += rate * g_emit / np.sqrt(squares[0][used])
            entry = np.zeros((len(whole), k))
            if len(model.lexicon):
                where = np.minimum(np.searchsorted(model.lexicon, whole), len(model.lexicon) - 1)
                entry = model.lexicon_of[where] * (model.lexicon[where] == whole)[:, None]
            for slot, (value, g) in enumerate(((model.lexicon_weight, (grad * entry).sum(0)), (model.move, seen - joint), (model.start, grad[first].sum(0))), 1):
                squares[slot] += g ** 2
                value += 0.1 * g / np.sqrt(squares[slot])
    return model


# ---- prediction ------------------------------------------------------------------------
def chain_ends(data: np.ndarray, s: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of words of each chain: words of one line of one row."""
    line = np.cumsum(data == 10)[s] if len(s) else s
    new = np.ones(len(s), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    return np.diff(np.append(np.flatnonzero(new), len(s)))


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) of every row's whole text.

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing was learned.
    ``n_switches``: how often the most likely label changes between words of a line."""
    ship(df.sparkSession)
    k = len(model.labels)

    def run(batches):
        for batch in batches:
            lettered = np.asarray(batch.column(2).fill_null(False))
            for lo, hi, data, offs in text_slices(batch.column(1), WIDE_SLICE):
                low, s, e, row = letter_words(data, offs)
                rows = hi - lo
                n = np.bincount(row, minlength=rows)
                total, switches = np.zeros((rows, max(k, 1))), np.zeros(rows, np.int64)
                if len(s) and k:
                    key = mix(raw_hash(prefix_sums(low), s, e))
                    _, first, back = np.unique(key, return_index=True, return_inverse=True)
                    score = emissions(model, *word_features(low, s[first], e[first]))[back]
                    lens = chain_ends(low, s, row)
                    p = posteriors(model, score, lens)
                    for j in range(k):
                        total[:, j] = np.bincount(row, p[:, j], rows)
                    best = p.argmax(1)
                    change = best[1:] != best[:-1]
                    change[np.cumsum(lens)[:-1] - 1] = False
                    switches = np.bincount(row[1:][change], minlength=rows)
                known = lettered[lo:hi] & (n > 0) & (k > 0)
                best = total.argmax(1)
                value = np.where(known, total[np.arange(rows), best] / np.maximum(n, 1), 0.0)
                names = [model.labels[b] if ok else "und" for b, ok in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(names, pa.string()), pa.array(np.clip(value, 0, 1)), pa.array(n), pa.array(switches, pa.int64())],
                    ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    t = F.col(text).cast("string")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), t.rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_switches long")


def identify(df: DataFrame, folds: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on rows outside the held-out fold (crc32 of the id as text) and predict every row."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
    known = df.where(fold != held).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = train(sample_spans(known, "lang", "text", SAMPLE_ROWS, SAMPLE_SPANS, SPAN))
    out = predict(df, model, doc_id, text)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
