"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations (op 7).

A hash function flips signs at random, applies a fast Walsh-Hadamard transform, three times
over, and names the axis (with sign) that is closest to the rotated vector.  ``HASHES`` such
functions make a table's bucket; ``TABLES`` tables are used.  Each vector also probes the
buckets of the next closest axes (multiprobe): the runner-up of each single function, those that
lose least first.

Candidates of a bucket are verified by their exact cosine in double precision.  A pair may meet
in several buckets; it counts only in the smallest one both have, so links are counted and
never listed in full: a bucket reports a number of links per vector and enough links to connect
what is linked.  Equal vectors are one vector with a count.  Buckets of more than ``BLOCK``
vectors are cut into blocks, and pairs of blocks are compared as tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import cut_lineage, mix, ship
from depthkit.llm.components import components

TABLES = 10
#: Functions of a table: the number of buckets is (2 * dimension) ** HASHES.
HASHES = 4
#: The vector's own bucket, one for each function's runner-up, and one where all take it.
PROBES = 6
#: Vectors of a bucket that one task compares with as many others.
BLOCK = 2048
_U = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, in place; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        low = y[:, :, 0] - y[:, :, 1]
        y[:, :, 0] += y[:, :, 1]
        y[:, :, 1] = low
        h *= 2
    x *= x.dtype.type(1 / np.sqrt(n))
    return x


def cells(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """Bucket names (rows x tables * probes) of unit vectors; the same for any batch of rows."""
    dim = vectors.shape[1]
    wide = 1 << max(1, int(np.ceil(np.log2(max(dim, 2)))))
    x = np.zeros((len(vectors), wide), np.float32)
    x[:, :dim] = vectors
    rng = np.random.default_rng(seed + 1000 * wide)
    out = np.empty((len(x), tables, probes), np.uint64)
    rows = np.arange(len(x))
    for t in range(tables):
        axis, other, gap = [], [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), wide))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            first, second = top[:, 0], top[:, 1]
            axis.append(2 * first + (y[rows, first] < 0))
            other.append(2 * second + (y[rows, second] < 0))
            gap.append(size[rows, first] - size[rows, second])
        order = np.argsort(np.stack(gap, 1), axis=1, kind="stable")
        for p in range(probes):
            name = np.full(len(x), _U(t + 1))
            for h in range(hashes):
                change = (order[:, p - 1] == h) if 0 < p <= hashes else np.zeros(len(x), bool)
                if p > hashes:  # all functions take their runner-up
                    change = np.ones(len(x), bool)
                name = mix(name * _U(1 << 20) + np.where(change, other[h], axis[h]).astype(np.uint64) + _U(1))
            out[:, t, p] = name
    return out.reshape(len(x), tables * probes)


def unit_rows(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, unit binary of doubles, cells array<long>); both null for vectors that link with nothing."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            unit, names = [None] * len(col), [None] * len(col)
            offs = np.asarray(col.offsets).astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            n = np.diff(offs)
            ok = np.asarray(col.is_valid()) & (n > 0)
            for dim in np.unique(n[ok]):
                some = np.flatnonzero(ok & (n == dim))
                x = flat[offs[some][:, None] + np.arange(dim)]
                with np.errstate(all="ignore"):
                    peak = np.abs(x).max(1)
                    x = x / peak[:, None]
                    x = x / np.sqrt((x * x).sum(1))[:, None]
                good = np.isfinite(x).all(1) & np.isfinite(peak)
                some, x = some[good], x[good] + 0.0
                for i, row, c in zip(some, x, cells(x).astype(np.int64) if len(x) else x):
                    unit[i], names[i] = row.tobytes(), np.sort(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit, pa.binary()), pa.array(names, pa.list_(pa.int64()))],
                                             ["vec_id", "unit", "cells"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id long, unit binary, cells array<long>")


def _pairs(group: np.ndarray, size: np.ndarray, small: int = 32):
    """Index pairs (a < b) within groups of adjacent rows: small groups all at once, large ones in turn."""
    low = np.flatnonzero(size <= small)
    for d in range(1, small):
        a = low[low + d < len(group)]
        a = a[group[a + d] == group[a]]
        if not len(a):
            break
        yield a, a + d, None
    for g in np.unique(group[size > small]):
        some = np.flatnonzero(group == g)
        for at in range(0, len(some), 512):
            yield some[at:at + 512], some, at


def _compare(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Links of whole groups (one bucket or pair of blocks each, rows adjacent): how many each vector
    has, and the smallest row it reaches inside its group."""
    bucket, i, j, side, rep, weight = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "rep", "n"))
    head = np.ones(len(rep), bool)
    head[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.cumsum(head) - 1
    size = np.bincount(group)[group]
    raw = table.column("unit").to_pylist()
    dim = np.array([len(r) // 8 for r in raw])
    names = [np.asarray(c) for c in table.column("cells").to_pylist()]
    wide = max((len(c) for c in names), default=0)
    cell = np.stack([np.resize(c, wide) for c in names])
    x = np.zeros((len(raw), dim.max()))
    for d in np.unique(dim):
        some = np.flatnonzero(dim == d)
        x[some, :d] = np.frombuffer(b"".join([raw[k] for k in some]), np.float64).reshape(-1, d)
    found = []
    for left, right, at in _pairs(group, size):
        if at is None:
            a, b = left, right
            close = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[close], b[close]
        else:
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            later = a + at < b
            a, b = left[a[later]], right[b[later]]
        fit = (dim[a] == dim[b]) & ((i[a] == j[a]) | (side[a] != side[b]))
        a, b = a[fit], b[fit]
        for k in range(0, len(a), 1 << 15):
            p, q = a[k:k + (1 << 15)], b[k:k + (1 << 15)]
            lower = np.zeros(len(p), bool)  # they also meet in a smaller bucket
            for c in range(wide):
                own = cell[p, c]
                lower |= (own < bucket[p]) & (cell[q] == own[:, None]).any(1)
            found.append((p[~lower], q[~lower]))
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    count, root = np.zeros(len(rep), np.int64), rep.copy()
    np.add.at(count, a, weight[b])
    np.add.at(count, b, weight[a])
    while len(a):
        new, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    keep = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(count[keep]), pa.array(root[keep])], ["rep", "links", "root"])


def _by_group(batches, threshold: float):
    """Feed whole groups to ``_compare``; a group's rows may span batches, and has at most 2 * BLOCK rows."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        if not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield _compare(table.slice(0, cut), threshold)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield _compare(held, threshold)


def near_duplicates(df: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding",
                    block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    ``n_links``: other vectors found with cosine >= threshold, equal vectors included.  Vectors
    that are null, empty, zero or hold null or non-finite components have none and are kept;
    vectors of different lengths are not compared.  Rows that repeat an id count as vectors of
    their own.  A null id is its own component (null) and is never linked."""
    rows = unit_rows(df, vec_id, vector).withColumn("row", F.monotonically_increasing_id())
    vectors = cut_lineage(rows, "vectors")  # numbers of rows are fixed from here on
    usable = vectors.where("unit is not null and vec_id is not null")
    reps = cut_lineage(usable.groupBy("unit").agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"),
                                                  F.first("cells").alias("cells")), "vectors")
    entries = reps.select("rep", F.explode(F.array_distinct("cells")).alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = entries.join(sizes, "bucket")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    entries = entries.select("rep", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    entries = entries.select("rep", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                             (F.col("own") > F.col("other")).cast("int").alias("side"))
    full = entries.join(reps.select("rep", "unit", "n", "cells"), "rep")
    schema = "rep long, links long, root long"
    full = full.select("bucket", "i", "j", "side", "rep", "n", "unit", "cells").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = full.mapInArrow(lambda batches: _by_group(batches, threshold), schema)
    found = cut_lineage(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    roots = reps.select("rep", "least", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    names = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut_lineage(roots.join(names, "component").join(links, "rep", "left").select(
        "rep", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "classes")
    out = vectors.select("vec_id", "unit").join(reps.select("unit", "rep"), "unit", "left").drop("unit").join(known, "rep", "left")
    linked = F.col("vec_id").isNotNull() & F.col("component_id").isNotNull()
    return out.select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.when(linked, F.col("component_id") == F.col("vec_id")).otherwise(True).alias("kept"))
