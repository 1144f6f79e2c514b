"""Ranked lexical search by bag deduplication (op 12).

Documents are restricted to the vocabulary of the items: a document's bag is the list of
(term, occurrences) of the item terms it holds.  Its score for any item depends on the bag and
on one number ``m`` from its length.  Documents with the same bag and the same ``m`` are one class:
a hash deals them, and grouping by the whole bag verifies that they are identical.  Each class
is scored once for all items, and only the classes that reach an item's first rows are expanded to
their members, by ascending id.  Of a class, no more than the ``k`` smallest ids can be in any
result; a row-number filter keeps those before and after the shuffle, so a class with very many
members is never in one place.

Items are taken in blocks whose text has about ``BLOCK_CHARS`` characters, so the vocabulary and
the postings that tasks receive are bounded whatever the size of the item table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthkit.llm.base import SLICE_BYTES, cut_lineage, mix, prefix_sums, ragged, raw_hash, ship, text_slices

#: Characters of item texts that one pass over the documents answers.
BLOCK_CHARS = 4_000_000
#: Bytes of document text that are worked on at once, and scores held at once.
SLICE, CELLS = SLICE_BYTES, 1 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered, starts, ends, rows) of the runs of ASCII letters, digits and characters beyond ASCII of each row."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    solid = _TERM[data]
    flag = np.ones(len(data), bool)
    flag[1:] = solid[1:] != solid[:-1]
    flag[offs[:-1][offs[:-1] < len(data)]] = True
    s = np.flatnonzero(flag)
    e = np.append(s[1:], len(data))
    e, s = e[solid[s]], s[solid[s]]
    return low, s, e, np.searchsorted(offs, s, "right") - 1


def _names(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(raw_hash(sums, s, e) ^ (e - s).astype(np.uint64))


class Vocabulary:
    """Numbers of known terms, found by hash and verified by their bytes."""

    def __init__(self, known: list[bytes]):
        ends = np.cumsum([len(t) for t in known], dtype=np.int64)
        starts = ends - np.array([len(t) for t in known], np.int64)
        data = np.frombuffer(b"".join(known), np.uint8)
        names = _names(prefix_sums(data), starts, ends) if known else np.zeros(0, np.uint64)
        self.order = np.argsort(names, kind="stable")
        self.names, self.starts, self.ends, self.data = names[self.order], starts[self.order], ends[self.order], data
        runs = np.diff(np.append(np.flatnonzero(np.diff(self.names, prepend=self.names[:1] + np.uint64(1))), len(names)))
        self.same = int(runs.max(initial=0))  # terms that share a hash

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Number of each span's term, -1 if it is not known."""
        out = np.full(len(s), -1, np.int64)
        if not len(s) or not len(self.names):
            return out
        names = _names(prefix_sums(data), s, e)
        at = np.searchsorted(self.names, names)
        for k in range(self.same):
            j = np.minimum(at + k, len(self.names) - 1)
            some = np.flatnonzero((out < 0) & (self.names[j] == names) & (self.ends[j] - self.starts[j] == e - s))
            j, lens = j[some], (e - s)[some]
            if not len(some):
                continue
            equal = data[ragged(s[some], lens)] == self.data[ragged(self.starts[j], lens)]
            equal = np.logical_and.reduceat(equal, np.cumsum(lens) - lens)
            out[some[equal]] = self.order[j[equal]]
        return out


def _pairs(rows: np.ndarray, numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, count) of distinct pairs, in order."""
    key, count = np.unique(rows * max(width, 1) + numbers, return_counts=True)
    return key // max(width, 1), key % max(width, 1), count


def _bags(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, bag) of each document: its terms with repeats, and its (number, occurrences) as 64-bit integers."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            col = batch.column(1)
            for lo, hi, data, offs in text_slices(col, SLICE):
                low, s, e, row = terms(data, offs)
                n = np.bincount(row, minlength=hi - lo)
                number = known.find(low, s, e)
                row, number, tf = _pairs(row[number >= 0], number[number >= 0], len(known.names))
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])
                for a in range(0, hi - lo, 1024):  # so that no batch outgrows 32-bit offsets
                    b = min(a + 1024, hi - lo)
                    body = np.stack([number[at[a]:at[b]], tf[at[a]:at[b]]], 1).astype("<i8")
                    bag = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(((at[a:b + 1] - at[a]) * 16).astype(np.int64)), pa.py_buffer(body.tobytes())])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a), pa.array(n[a:b]), bag.cast(pa.binary())], ["id", "n", "bag"])

    return docs.mapInArrow(run, "id long, n long, bag binary")


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, tf) of the entries of bags."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]].tobytes()
    both = np.frombuffer(body, "<i8").reshape(-1, 2)
    return np.repeat(np.arange(len(col)), np.diff(offs) // 16), both[:, 0], both[:, 1]


def _frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; one row per term of the block reaches the driver."""

    def run(batches):
        count = np.zeros(size, np.int64)
        for batch in batches:
            _, number, _ = _unpacked(batch.column(0))
            count += np.bincount(number, minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["number", "df"])

    out = np.zeros(size, np.int64)
    for r in bags.select("bag").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["number"]] = r["df"]
    return out


class Best:
    """The best ``k`` rows of each item so far: score, then smaller id."""

    def __init__(self, items: int, k: int):
        self.k, self.kth, self.rows = k, np.zeros(items, np.int64), [np.zeros(0, np.int64)] * 3

    def add(self, score: np.ndarray, members: list[np.ndarray]) -> None:
        """Scores (class x item) and the ascending ids of each class."""
        c, i = np.nonzero((score > 0) & (score >= self.kth))
        value, first = score[c, i], np.array([m[0] for m in members], np.int64)[c]
        order = np.lexsort((first, -value, i))
        c, i, value = c[order], i[order], value[order]
        ahead = np.arange(len(i)) - np.searchsorted(i, i) < self.k  # each class has a member, so k classes are enough
        c, i, value = c[ahead], i[ahead], value[ahead]
        size = np.array([len(members[x]) for x in c], np.int64)
        ids = np.concatenate([members[x] for x in c]) if len(c) else np.zeros(0, np.int64)
        item, value, ids = (np.concatenate(p) for p in zip(self.rows, [np.repeat(i, size), np.repeat(value, size), ids]))
        order = np.lexsort((ids, -value, item))
        item, value, ids = item[order], value[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.kth[item[last]] = value[last]
        self.rows = [item[place < self.k], value[place < self.k], ids[place < self.k]]


def _postings(asked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, items, repeats) by term from rows of (item, term, repeats)."""
    order = np.argsort(asked[:, 1], kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(asked[:, 1], minlength=size))]), asked[order, 0], asked[order, 2]


def _scored(classes: DataFrame, weights, n_items: int, k: int) -> DataFrame:
    """The best rows of each item in each task."""

    def run(batches):
        w, (at, items, repeats) = weights.value
        best, most = Best(n_items, k), max(1, CELLS // max(n_items, 1))
        for whole in batches:
            for a in range(0, whole.num_rows, most):
                batch = whole.slice(a, most)
                row, number, tf = _unpacked(batch.column(1))
                m = batch.column(0).to_numpy()[row]
                value = w[number] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                score = np.zeros((batch.num_rows, n_items), np.int64)
                order = np.argsort(number, kind="stable")
                row, number, value = row[order], number[order], value[order]
                for some in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1) if len(number) else []:
                    t = number[some[0]]
                    score[np.ix_(row[some], items[at[t]:at[t + 1]])] += value[some][:, None] * repeats[at[t]:at[t + 1]][None, :]
                best.add(score, [np.asarray(x) for x in batch.column(2).to_numpy(zero_copy_only=False)])
        item, value, ids = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids), pa.array(value)], ["item", "doc_id", "score"])

    return classes.select("m", "bag", "members").mapInArrow(run, "item long, doc_id long, score long")


def _block(items: list, docs: DataFrame, k: int) -> DataFrame:
    """Results of the items of one block: rows (item_id, text), a bounded amount of text."""
    spark = docs.sparkSession
    col = pa.array([r[1] for r in items], pa.large_string())
    name_of = sorted({r[0] for r in items})
    item_of = np.searchsorted(np.array(name_of), np.array([r[0] for r in items]))
    number, rows = {}, []
    for lo, _, data, offs in text_slices(col):
        low, s, e, row = terms(data, offs)
        body = low.tobytes()
        for a, b, r in zip(s.tolist(), e.tolist(), row.tolist()):
            rows.append((item_of[lo + r], number.setdefault(body[a:b], len(number))))
    asked = np.array(rows, np.int64).reshape(-1, 2)
    asked = np.stack(_pairs(asked[:, 0], asked[:, 1], len(number)), 1)
    bags = cut_lineage(_bags(docs, spark.sparkContext.broadcast(Vocabulary(list(number)))), "bags")
    total = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    df = _frequencies(bags, len(number))
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    m = (F.lit(100 - 25) + F.expr(f"(25 * n * {n_docs}) div {max(n_terms, 1)}")).cast("long")
    # a class: same m, same bag; the hash deals classes to tasks, the bag itself is compared
    held = bags.where("id is not null and length(bag) > 0").select("id", m.alias("m"), "bag", F.xxhash64("bag").alias("hash"))
    ahead = Window.partitionBy("hash", "m", "bag").orderBy("id")
    few = held.withColumn("place", F.row_number().over(ahead)).where(F.col("place") <= k)
    classes = few.groupBy("hash", "m", "bag").agg(F.sort_array(F.collect_list("id")).alias("members"))
    weights = spark.sparkContext.broadcast((w, _postings(asked, len(number))))
    best = _scored(classes, weights, len(name_of), k)
    names = spark.createDataFrame(list(enumerate(name_of)), "item long, item_id long")  # a block's items
    top = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's m is 75 + (25 n N) div L; its
    score sums w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with repeats.  Null texts
    have no terms.  Each row of ``docs`` is a document; rows without an id count in N, L and df, and are
    not returned.  Rows of ``items`` with one id are one item; rows without an id ask nothing."""
    spark = docs.sparkSession
    ship(spark)
    body = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    asks = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = asks.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    out = None
    for b in range(blocks):
        some = asks.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block: about block_chars characters
        if some:
            found = _block(some, body, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
