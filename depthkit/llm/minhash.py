"""MinHash near-duplicates by improved consistent weighted sampling (op 9).

Features of a text are its shingles of five words; a feature's weight is tf * idf.  For each of
``SAMPLES`` hash functions, consistent weighted sampling draws one (feature, level) so that two
texts draw the same with probability equal to their weighted Jaccard similarity.  Bands of
``ROWS`` draws make buckets; candidate pairs from buckets are verified by their exact weighted
Jaccard similarity, and verified links give classes.

* tf is sublinear, 1 + ln(count), so that one line repeated a hundred times does not outweigh
  the rest of a text.
* idf(s) = ln(1 + 1 / max(df / n, RARE)) / ln(1 + 1 / RARE): 1 for a shingle in up to a tenth
  of all documents, less for boilerplate.  Below that share the formula gives 1 whatever the document
  frequency is, so only shingles above it need one; a superset of them is proposed first, and another pass
  counts those exactly.
* Exact copies (equal word sequences) are one text from the start.  With ``fold_copies`` they
  also count once in df and n, so that how many copies a text has does not change what it is
  similar to.  Either way all texts propose the superset, by lossy counting per task (with proven bounds on
  error and size).
* No bucket emits its pairs.  Each text is first compared with one leader of its buckets (the
  texts that meet most others lead).  What is then in another component than its bucket's
  leader is compared with the rest of the bucket inside tasks of bounded size: full signatures
  (``SAMPLES`` draws) rule out pairs that cannot be similar (an estimate below THRESHOLD - 0.2
  is four standard deviations off), shingles of the others are fetched and compared, and each
  task reports only which texts it connects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import cut_lineage, mix, ragged, ship, span_hashes, text_slices, words
from depthkit.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
RARE = 0.1
#: Error of lossy counting, as a share of documents.
LOSSY = RARE / 10
#: Without effect: common shingles are proposed by all texts.  Kept for callers that pass it.
SAMPLE_TEXTS = 4000
#: Texts of a bucket that one task compares with as many others.
BLOCK = 512
_POOL_BITS = 14
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


@dataclass(frozen=True)
class Features:
    """Distinct shingles of each row of a slice, sorted by row."""

    row: np.ndarray  # row of each feature
    key: np.ndarray  # 48-bit hash
    tf: np.ndarray
    one: np.ndarray  # two 64-bit hashes of each row's word sequence
    two: np.ndarray
    n_words: np.ndarray


def _sequence_hash(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each row's sequence of word hashes: words are mixed with their place, since a polynomial
    modulo 2^64 has known pairs of sequences with equal values."""
    place = np.arange(len(h)) - np.repeat(first, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(place.astype(np.uint64) + _U(1))))])
    return mix((sums[first + n] - sums[first]) ^ n.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def sequences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word hashes, their rows, words of each row, two hashes of each row's word sequence) of a slice."""
    rows = len(offs) - 1
    data = _LOWER[data]
    s, e, row = words(data, offs)
    h = span_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    return h, row, n, _sequence_hash(h, first, n), _sequence_hash(mix(h ^ _U(0xA5A5A5A55A5A5A5A)), first, n)


def features(data: np.ndarray, offs: np.ndarray) -> Features:
    """Shingles of every row of a slice.  Texts of one to four words have one: the text."""
    rows = len(offs) - 1
    h, row, n, one, two = sequences(data, offs)
    k = SHINGLE
    if len(h) >= k:
        a = np.flatnonzero(row[k - 1:] == row[:len(row) - k + 1])
        key = h[a]
        for i in range(1, k):
            key = mix(key) + h[a + i]
        key, own = mix(key), row[a]
    else:
        key, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    key, own = np.concatenate([key, one[short]]), np.concatenate([own, short])
    full = np.sort((own.astype(np.uint64) << _U(48)) | (key >> _U(16))) if rows < 1 << 16 else None
    head = np.ones(len(full), bool)
    head[1:] = full[1:] != full[:-1]
    at = np.flatnonzero(head)
    tf = np.diff(np.append(at, len(full)))
    full = full[at]
    return Features((full >> _U(48)).astype(np.int64), full & _U((1 << 48) - 1), tf, one, two, n)


# ---- idf -----------------------------------------------------------------------------
def _proposed(texts: DataFrame, share: float, rare: float, distinct: int | None = None) -> tuple[int, np.ndarray]:
    """Texts counted by all tasks, and all shingles that may be in at least ``rare`` of the texts (or of ``distinct`` ones).

    With ``distinct``, a task counts a text once, by the hashes of its word sequence.  Several tasks may count it,
    so the sums are never too small.  A task drops shingles in less than ``share`` of what it has
    counted, by lossy counting in a bounded table; what it may have dropped is added to the sums."""
    lossy = share * 2 * LOSSY / RARE

    def propose(batches):
        key, count, slack, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), 0
        held = set()
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                if distinct is not None:
                    _, some = _unseen(data, offs, held)
                    if not len(some):
                        continue
                    data, offs = _pick(data, offs, some)
                f = features(data, offs)
                new, n = np.unique(f.key, return_counts=True)
                at = np.searchsorted(key, new)
                at_ = np.minimum(at, max(len(key) - 1, 0))
                old = (key[at_] == new) if len(key) else np.zeros(len(new), bool)
                count[at_[old]] += n[old]
                missed = lossy * seen
                seen += len(offs) - 1
                key = np.concatenate([key, new[~old]])
                count = np.concatenate([count, n[~old]])
                slack = np.concatenate([slack, np.full(len(key) - len(slack), missed)])
                stay = count + slack > lossy * seen
                order = np.argsort(key[stay])
                key, count, slack = key[stay][order], count[stay][order], slack[stay][order]
        stay = count + slack >= share * seen
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], key[stay].astype(np.int64)])), pa.array(np.concatenate([[seen], count[stay] + slack[stay]]), pa.float64()),
             pa.array(np.full(1 + int(stay.sum()), seen), pa.int64())], ["key", "most", "seen"])

    rows = cut_lineage(texts.mapInArrow(propose, "key long, most double, seen long").groupBy("key").agg(
        F.sum("most").alias("most"), F.sum("seen").alias("seen")), "shingles")
    total = rows.where("key = -1").first()
    n = int(total["seen"]) if total else 0
    least = rare * (n if distinct is None else distinct)
    found = [r[0] for r in rows.where(F.col("key") >= 0).where(
        F.col("most") + share * (n - F.col("seen")) >= least * (1 - 1e-9)).select("key").collect()] if n else []
    return n, np.sort(np.array(found, np.uint64))


def common_shingles(texts: DataFrame, rare: float = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, document frequencies, documents) of all shingles in more than ``rare`` of the documents.

    A shingle with frequency >= rare * n must reach half that share in tasks that hold much of it;
    lossy counting keeps a bounded table in each task and overestimates by LOSSY at most.  What
    is left after adding up has at most (mean length) / (rare / 2 - LOSSY) shingles."""
    ship(texts.sparkSession)

    n, keys = _proposed(texts, rare / 2, rare)
    if not len(keys):
        return keys, np.zeros(0, np.int64), n

    def exact(batches):
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                f = features(data, offs).key
                at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                total += np.bincount(at[keys[at] == f], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(total)], ["key", "n"])

    counted = texts.mapInArrow(exact, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    df = dict((int(r[0]), int(r[1])) for r in counted)
    freq = np.array([df.get(int(k), 0) for k in keys], np.int64)
    stay = freq > rare * n
    return keys[stay], freq[stay], n


def _pick(data: np.ndarray, offs: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice of some rows of a slice."""
    n = offs[some + 1] - offs[some]
    return data[ragged(offs[some], n)], np.concatenate([[0], np.cumsum(n)])


def _distinct(one: np.ndarray, two: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The rows among ``some`` that hold the first of each pair of hashes."""
    pairs = np.stack([one[some], two[some]], 1)
    return some[np.sort(np.unique(pairs, axis=0, return_index=True)[1])]


def _unseen(data: np.ndarray, offs: np.ndarray, held: set) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of the word sequences of a slice, and its rows with words whose hashes are not in ``held`` yet (they are then)."""
    _, _, n, one, two = sequences(data, offs)
    some = _distinct(one, two, np.flatnonzero(n))
    pairs = list(zip(one[some].tolist(), two[some].tolist()))
    new = np.array([p not in held for p in pairs], bool)
    held.update(pairs)
    return (one, two), some[new]


def common_shingles_of_distinct(texts: DataFrame, rare: float = RARE, sample: int = SAMPLE_TEXTS) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, document frequencies, documents) of all shingles in more than ``rare`` of the distinct texts with words.

    Copies are folded in each task and then over all tasks, by the hashes of the word sequence.  All texts
    propose shingles: a task counts each of its distinct texts, so a text may count in several tasks, and
    tasks drop only what is too rare to reach ``rare / 2`` of the distinct texts over all of them.  The proposed
    shingles are then counted exactly.  ``sample`` is without effect."""
    ship(texts.sparkSession)

    def hashes(batches):
        held = set()
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                (one, two), some = _unseen(data, offs, held)
                yield pa.RecordBatch.from_arrays([pa.array(one[some].astype(np.int64)), pa.array(two[some].astype(np.int64))], ["one", "two"])

    each = texts.mapInArrow(hashes, "one long, two long").groupBy("one", "two").agg(F.count(F.lit(1)).alias("tasks"))
    n, counted = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("tasks"), F.lit(0))).first()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    _, keys = _proposed(texts, rare / 2 * n / counted, rare, n)
    if not len(keys):
        return keys, np.zeros(0, np.int64), n

    def places(batches):
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                _, _, n_words, one, two = sequences(data, offs)
                some = _distinct(one, two, np.flatnonzero(n_words))
                f = features(*_pick(data, offs, some))
                at = np.minimum(np.searchsorted(keys, f.key), len(keys) - 1)
                hit = keys[at] == f.key
                cut = np.searchsorted(f.row[hit], np.arange(len(some) + 1))
                at = at[hit].astype("<u4")
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.one[full].astype(np.int64)), pa.array(f.two[full].astype(np.int64)),
                     pa.array([at[cut[r]:cut[r + 1]].tobytes() for r in full], pa.binary())], ["one", "two", "at"])

    def count(batches):
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total)], ["key", "n"])

    once = texts.mapInArrow(places, "one long, two long, at binary").dropDuplicates(["one", "two"])
    freq = np.zeros(len(keys), np.int64)
    for k, v in once.select("at").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        freq[k] = v
    stay = freq > rare * n
    return keys[stay], freq[stay], n


def weights(key: np.ndarray, tf: np.ndarray, common: tuple, rare: float = RARE) -> np.ndarray:
    keys, freq, n = common
    w = 1 + np.log(tf)
    if len(keys) and len(key):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        idf = np.log1p(n / np.maximum(freq, rare * n)) / np.log1p(1 / rare)
        w[hit] *= idf[at[hit]]
    return w


# ---- sampling -------------------------------------------------------------------------
class Sampler:
    """Consistent weighted samples.  The random r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of a feature
    and a hash function come from a pool, at a place given by the feature's hash."""

    def __init__(self, samples: int = SAMPLES, seed: int = 20):
        rng = np.random.default_rng(seed)
        size = 1 << _POOL_BITS
        self.mul = rng.integers(1 << 62, size=samples, dtype=np.uint64) * _U(2) + _U(1)
        self.r = rng.gamma(2, 1, (samples, size)).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, (samples, size))).astype(np.float32)
        self.beta = rng.random((samples, size), dtype=np.float32)
        self.unit = self._ordered(self.c - self.r * (1 - self.beta))  # for weight 1, where the level is 0

    @staticmethod
    def _ordered(x: np.ndarray) -> np.ndarray:
        """Floats as integers of the same order, in the upper half of 64 bits."""
        bits = x.astype(np.float32).view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << _U(32)

    def draw(self, key: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Signatures (rows x samples, uint32) of groups of features that begin at ``first``."""
        out = np.empty((len(first), len(self.mul)), np.uint32)
        odd = np.flatnonzero(w != 1)
        log_w = np.log(w[odd]).astype(np.float32)
        base = mix(key)
        for k, m in enumerate(self.mul):
            h = base * m
            place = (h >> _U(64 - _POOL_BITS)).astype(np.int64)
            low = (h >> _U(12)) & _U(0xFFFFFFFF)
            order = self.unit[k][place]
            if len(odd):
                p = place[odd]
                r, beta = self.r[k][p], self.beta[k][p]
                level = np.floor(log_w / r + beta)
                order[odd] = self._ordered(self.c[k][p] - r * (level - beta) - r)
                low[odd] ^= mix(level.astype(np.int64).astype(np.uint64) + _U(7)) * (level != 0) & _U(0xFFFFFFFF)
            out[:, k] = (np.minimum.reduceat(order | low, first) & _U(0xFFFFFFFF)).astype(np.uint32)
        return out


_sampler: dict[int, Sampler] = {}


def sampler() -> Sampler:
    if 0 not in _sampler:
        _sampler[0] = Sampler()
    return _sampler[0]


def signatures(docs: DataFrame, common: tuple) -> DataFrame:
    """(doc_id, one, two, bands array<long>, sig binary) of every row; bands are null without words."""
    ship(docs.sparkSession)
    salt = mix(np.arange(BANDS, dtype=np.uint64) + _U(99))

    def run(batches):
        draw = sampler().draw
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1)):
                f = features(data, offs)
                rows = hi - lo
                some, first = np.unique(f.row, return_index=True)
                sig = np.zeros((rows, SAMPLES), np.uint32)
                if len(some):
                    sig[some] = draw(f.key, weights(f.key, f.tf, common), first)
                parts = sig.reshape(rows, BANDS, ROWS).astype(np.uint64)
                band = parts[:, :, 0]
                for i in range(1, ROWS):
                    band = mix(band) + parts[:, :, i]
                band = (mix(band ^ salt)).astype(np.int64)
                none = f.n_words == 0
                bands = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(band.reshape(-1)))
                bands = pa.array(bands.to_pylist(), pa.list_(pa.int64()), mask=none) if none.any() else bands
                raw = sig.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(f.one.astype(np.int64)), pa.array(f.two.astype(np.int64)), bands,
                     pa.array([x.tobytes() for x in raw], pa.binary())], ["doc_id", "one", "two", "bands", "sig"])

    return docs.mapInArrow(run, "doc_id long, one long, two long, bands array<long>, sig binary")


def _estimate(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b, ...) with ``est``, the share of equal draws, where it is high enough."""
    names = [c for c in pairs.columns if c not in ("sig_a", "sig_b")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SAMPLES) for c in ("sig_a", "sig_b"))
            est = (x == y).mean(1)
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(est)], [*names, "est"])
            yield out.filter(pa.array(est >= least))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(names).schema)
    return pairs.mapInArrow(run, schema + ", est double")


def id_filter(ids: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of a one-hash Bloom filter over ``rep``, of 128 KB to 64 MB.

    16 bits an id up to that size; more ids only let more texts through, which a join drops."""
    wanted = 16 * max(1, ids.count())
    bits = 1 << min(29, max(20, int(np.ceil(np.log2(wanted)))))
    h = F.pmod(F.xxhash64("rep"), F.lit(bits))
    rows = ids.select(F.floor(h / 32768).alias("b"), (h % 32768).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in rows:
        out[int(b) * 4096:(int(b) + 1) * 4096] = np.frombuffer(bytes(m), np.uint8)
    return bits, out


def shingle_sets(ids: DataFrame, docs: DataFrame, common: tuple, names: DataFrame) -> DataFrame:
    """(rep, k, w): shingle keys and weights of some texts, read again and written.

    ``names`` has the smallest doc_id (``least``) and the hashes of each text.  Texts are filtered
    where they are read and never shuffled; only their shingles are."""
    wanted = cut_lineage(ids.select("rep").distinct().join(names.select("rep", "least", "one", "two"), "rep"), "wanted")
    bits, bitmap = id_filter(wanted.select(F.col("least").alias("rep")))

    def run(batches):
        for batch in batches:
            h = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bitmap[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for lo, hi, data, offs in text_slices(batch.column(1)):
                f = features(data, offs)
                cut = np.searchsorted(f.row, np.arange(hi - lo + 1))
                w = weights(f.key, f.tf, common)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(f.one.astype(np.int64)), pa.array(f.two.astype(np.int64)),
                     pa.array([f.key[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                     pa.array([w[i:j].astype("<f4").tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["least", "one", "two", "k", "w"])

    rows = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h"))
    sets = rows.mapInArrow(run, "least long, one long, two long, k binary, w binary").join(wanted, ["least", "one", "two"])
    return cut_lineage(sets.select("rep", "k", "w").dropDuplicates(["rep"]), "shingles")  # rows that repeat id and text


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) with ``similarity``, their weighted Jaccard, where it is high enough."""
    def compare(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            ka, wa, kb, wb = (batch.column(c).to_pylist() for c in ("ka", "wa", "kb", "wb"))
            for i in range(len(out)):
                x, y = np.frombuffer(ka[i], np.uint64), np.frombuffer(kb[i], np.uint64)
                u, v = np.frombuffer(wa[i], "<f4").astype(float), np.frombuffer(wb[i], "<f4").astype(float)
                if not len(x) or not len(y):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                hit = y[at] == x
                both = np.minimum(u[hit], v[at[hit]]).sum()
                out[i] = both / (u.sum() + v.sum() - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "similarity"]).filter(
                pa.array(out >= threshold - 1e-6))

    joined = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("k").alias("ka"), F.col("w").alias("wa")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("k").alias("kb"), F.col("w").alias("wb")), "b")
    return joined.mapInArrow(compare, "a long, b long, similarity double")


# ---- inside buckets ------------------------------------------------------------------------
_KEY = ["bucket", "o", "m"]


def _groups(batches):
    """Tables of the adjacent rows of one (bucket, o, m), each at most 2 * BLOCK rows."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        if not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in _KEY]
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _open_pairs(table: pa.Table):
    """Sides of a group: indices of outliers and members, and which pairs are still to be compared here:
    in different components, and with no smaller bucket in common."""
    side, component = table.column("side").to_numpy(), table.column("component").to_numpy()
    bands = np.asarray(table.column("bands").combine_chunks().values).reshape(-1, BANDS)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    open_ = component[x][:, None] != component[y][None, :]
    first = int(table.column("bucket")[0].as_py())
    for c in range(BANDS):
        lower = bands[x, c] < first
        if lower.any() and open_.any():
            open_ &= ~(lower[:, None] & (bands[x, c][:, None] == bands[y, c][None, :]))
    return x, y, open_


def _active(batches, least: float):
    """Rows of those texts that may be similar to a text of another component, by their signatures."""
    for table in _groups(batches):
        x, y, open_ = _open_pairs(table)
        if not open_.any():
            continue
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, SAMPLES)
        some = open_.any(1)
        x, open_ = x[some], open_[some]
        for r in range(len(x)):
            open_[r] &= (sig[y] == sig[x[r]]).mean(1) >= least
        keep = np.concatenate([x[open_.any(1)], y[open_.any(0)]])
        if len(keep):
            yield from table.drop_columns(["sig"]).take(pa.array(keep)).combine_chunks().to_batches()


def _connect(batches, threshold: float):
    """(a, b) for each text that is linked within a group, b being the smallest text it reaches there."""
    for table in _groups(batches):
        x, y, open_ = _open_pairs(table)
        if not open_.any():
            continue
        rep = table.column("rep").to_numpy()
        keys = [np.frombuffer(k, np.uint64) for k in table.column("k").to_pylist()]
        w = [np.frombuffer(k, "<f4").astype(float) for k in table.column("w").to_pylist()]
        n = np.array([len(k) for k in keys])
        _, flat = np.unique(np.concatenate(keys), return_inverse=True)
        at = np.cumsum(n) - n
        total = np.array([v.sum() for v in w])
        inner = ragged(at[y], n[y])
        flat_y, w_y, owner = flat[inner], np.concatenate([w[i] for i in y]), np.repeat(np.arange(len(y)), n[y])
        dense = np.zeros(int(flat.max()) + 1 if len(flat) else 1)
        root = {int(r): int(r) for r in rep}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for r, i in enumerate(x):
            if not open_[r].any():
                continue
            own = flat[at[i]:at[i] + n[i]]
            dense[own] = w[i]
            both = np.bincount(owner, np.minimum(dense[flat_y], w_y), len(y))
            dense[own] = 0
            with np.errstate(all="ignore"):
                like = both / (total[i] + total[y] - both)
            for q in y[open_[r] & (like >= threshold - 1e-6)]:
                a, b = find(int(rep[i])), find(int(rep[q]))
                root[max(a, b)] = min(a, b)
        out = [(k, find(k)) for k in root if find(k) != k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])


def _rest_of_buckets(placed: DataFrame, reps: DataFrame, docs: DataFrame, common: tuple, threshold: float, block: int, names: DataFrame) -> DataFrame:
    """Links between texts of a bucket that are not yet in one component.

    ``placed``: (bucket, rep, component, home).  Outliers (other component than the leader) of a
    bucket and all its members are cut into blocks; a task has one block of either."""
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("component") != F.col("home")).cast("long")).alias("n_out"))
    sizes = sizes.where("n_out > 0").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("bm"), F.ceil(F.col("n_out") / block).cast("int").alias("bo"))
    rows = placed.join(sizes, "bucket")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = rows.where("component <> home").select(
        "bucket", own("bo").alias("o"), F.explode(F.sequence(F.lit(0), F.col("bm") - 1)).alias("m"), F.lit(0).alias("side"), "rep", "component")
    right = rows.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("bo") - 1)).alias("o"), own("bm").alias("m"), F.lit(1).alias("side"), "rep", "component")
    entries = left.unionByName(right.select(left.columns))
    full = entries.join(reps, "rep").select(*_KEY, "side", "rep", "component", "bands", "sig")
    full = full.repartition(*_KEY).sortWithinPartitions(*_KEY)
    schema = "bucket long, o int, m int, side int, rep long, component long, bands array<long>"
    active = cut_lineage(full.mapInArrow(lambda it: _active(it, threshold - 0.2), schema), "active")
    sets = shingle_sets(active.select("rep"), docs, common, names)
    again = active.join(sets, "rep").repartition(*_KEY).sortWithinPartitions(*_KEY)
    return again.select(*_KEY, "side", "rep", "component", "bands", "k", "w").mapInArrow(lambda it: _connect(it, threshold), "a long, b long")


def _classes(df: DataFrame, threshold: float, doc_id: str, text: str, block: int, fold_copies: bool) -> DataFrame:
    """(doc_id, one, two, class_id, n_copies, kept) of every row; ``one`` and ``two`` are the hashes of its words.

    From here on a text, not an id, is what has copies, shingles and links: ``rep`` is its number."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    common = (common_shingles_of_distinct if fold_copies else common_shingles)(docs.select("text"))
    sigs = cut_lineage(signatures(docs, common), "signatures")
    usable = sigs.where("doc_id is not null and bands is not null")
    texts = usable.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("s"))
    texts = cut_lineage(texts.withColumn("rep", F.monotonically_increasing_id()), "copies")  # numbers are fixed from here on
    reps = texts.select("rep", "s.bands", "s.sig")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(members.join(sizes, "bucket"), "buckets")
    reach = members.groupBy("rep").agg(F.sum("n").alias("reach"))
    leaders = members.join(reach, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("reach", -F.col("rep"))).alias("leader"))
    members = cut_lineage(members.select("rep", "bucket").join(leaders, "bucket"), "buckets")
    sig_a, sig_b = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    # each text against the most similar of its leaders
    stars = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = _estimate(stars.join(sig_a, "a").join(sig_b, "b"), threshold - 0.2)
    best = cut_lineage(stars.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b"), "stars")
    sets = shingle_sets(best.select(F.explode(F.array("a", "b")).alias("rep")), docs, common, texts)
    roots = components(verify(best, sets, threshold).select("a", "b"))
    placed = members.join(roots.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    homes = placed.where("rep = leader").select("bucket", F.col("component").alias("home"))
    placed = cut_lineage(placed.select("rep", "bucket", "component").join(homes, "bucket"), "buckets")
    more = cut_lineage(_rest_of_buckets(placed, reps, docs, common, threshold, block, texts), "links")
    if more.head() is not None:
        roots = components(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = texts.select("rep", "one", "two", "least", "n_copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = named.groupBy("component").agg(F.min("least").alias("class_id"))
    known = named.join(ids, "component").select("one", "two", "class_id", "n_copies", F.lit(True).alias("usable"))
    out = sigs.select("doc_id", "one", "two", F.col("bands").isNotNull().alias("usable")).join(known, ["one", "two", "usable"], "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "one", "two", class_id.alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
                      F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text",
                    block: int = BLOCK, fold_copies: bool = False) -> DataFrame:
    """(doc_id, class_id, n_copies, kept) of every row.

    ``class_id`` is the smallest doc_id reachable by links of similarity >= threshold, exact
    copies included; ``n_copies`` counts rows with the same word sequence; ``kept`` marks rows
    whose id is the class id.  Texts without words and rows with a null id are classes of their
    own (class_id is the id itself).  An id that repeats with different texts is in a class for each
    of them.  ``fold_copies`` counts document frequencies over distinct texts instead of
    all rows."""
    return _classes(df, threshold, doc_id, text, block, fold_copies).select("doc_id", "class_id", "n_copies", "kept")


def _text_hashes(texts: DataFrame) -> DataFrame:
    """(doc_id, text, one, two) of a table of (doc_id, text)."""
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1)):
                _, _, _, one, two = sequences(data, offs)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64))],
                                                 ["doc_id", "text", "one", "two"])

    return texts.mapInArrow(run, "doc_id long, text string, one long, two long")


def keep_first(df: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text",
               fold_copies: bool = False) -> DataFrame:
    """The rows of ``df``, all columns, without the near copies of another row: one document of each class.

    Rows that repeat a kept id with the same text are reduced to one; where an id repeats with
    different texts, each text is judged on its own."""
    classes = cut_lineage(_classes(df, threshold, doc_id, text, BLOCK, fold_copies), "classes")
    again = classes.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id")
    gone = classes.where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    own = F.col(doc_id).cast("long") == F.col("__id")
    if again.head() is None:
        return df.join(gone, own, "left_anti")
    again = cut_lineage(again, "repeated")
    once = df.join(again.unionByName(gone).distinct(), own, "left_anti")
    rows = df.join(again, own, "left_semi")
    hashes = _text_hashes(rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).distinct())
    stay = hashes.join(classes.where("kept").select("doc_id", "one", "two").distinct(), ["doc_id", "one", "two"], "left_semi")
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    rows = rows.join(stay, own & F.col(text).cast("string").eqNullSafe(F.col("__text")), "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(rows)
