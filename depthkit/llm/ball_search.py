"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound (op 13).

Components become integers, so scores are exact.  Vectors are dealt to shards of about
``SHARD`` rows by a hash of the row.  A task receives one shard and a block of queries, shard
first; it builds the shard's ball tree and then takes the queries batch by batch, so it holds
one shard and one batch.  A node's ball (centre ``c``, radius ``r``) bounds every score in it by
``q.c + |q| r``.  A query first descends to the leaf with the best bound, then drops all nodes whose
bound is under its kth score, and visits the leaves that are left by falling bound, dropping more
as its kth score rises.

The kth score is shared between shards: in a first round each query searches its own shard
only, and it takes the kth score found there to all other shards in the second round, which return
nothing but rows that beat it.  Equal scores go to smaller ids: nodes know their smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthkit.llm.base import cut_lineage, ship

#: Rows of a shard (mean), queries that one task takes to a shard (mean), rows of a leaf.
SHARD, BLOCK, LEAF = 16384, 65536, 64
#: Queries searched at once.
BATCH = 256
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)
HUGE = 1e150
_LONG = (1 << 63) - 1
_NONE = np.int64(-_LONG - 1)


class Tree:
    """Ball tree over the rows of ``x`` (doubles holding integers); nodes in level order, children of i at 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x) / leaf)))))
        order, spans = np.arange(len(x)), [(0, len(x))]
        for level in range(self.depth):
            for a, b in spans[-(1 << level):]:
                some = order[a:b]
                mid = (b - a) // 2
                if b - a > 1:
                    v = x[some]
                    far = v[np.argmax(_square(v - v.mean(0)))]  # split between two points that are far apart
                    other = v[np.argmax(_square(v - far))]
                    scale = max(1.0, float(np.abs(other - far).max(initial=0)))
                    order[a:b] = some[np.argsort((v / scale) @ ((other - far) / scale), kind="stable")]
                spans += [(a, a + mid), (a + mid, b)]
        self.x, self.ids, self.rows, self.span = x[order], ids[order], rows[order], np.array(spans)
        n, dim = len(spans), x.shape[1]
        self.centre, self.radius, self.least, self.size = np.zeros((n, dim)), np.full(n, -1.0), np.full(n, _LONG), np.zeros(n)
        for i, (a, b) in enumerate(spans):
            if b > a:
                self.centre[i] = self.x[a:b].mean(0)
                self.radius[i] = np.sqrt(_square(self.x[a:b] - self.centre[i]).max()) * (1 + 1e-9)
                self.least[i] = self.ids[a:b].min()
                self.size[i] = np.sqrt(_square(self.x[a:b]).max())

    def bound(self, q: np.ndarray, norm: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of queries in nodes (pairwise), widened by what rounding may take."""
        with np.errstate(all="ignore"):
            top = np.einsum("ij,ij->i", q, self.centre[nodes]) + norm * self.radius[nodes]
            top += (1 + norm * (self.size[nodes] + self.radius[nodes])) * 1e-9
        top[(norm > HUGE) | (self.size[nodes] > HUGE)] = np.inf  # squares of such lengths overflow: always visited
        return np.where(self.radius[nodes] < 0, -np.inf, top)


def _square(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.minimum(np.einsum("ij,ij->i", x, x), np.finfo(float).max / 4)


def _scores(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products as longs; beyond the range of doubles by Python's integers, held to the range of longs."""
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    a, b = ([[int(v) for v in row] for row in m] for m in (q, x))
    return np.array([[max(-_LONG, min(_LONG, sum(u * v for u, v in zip(r, s)))) for s in b] for r in a], np.int64).reshape(len(a), len(b))


class Search:
    """A batch of queries with the best ``k`` (score, id) found so far."""

    def __init__(self, q: np.ndarray, rows: np.ndarray, score: np.ndarray, least: np.ndarray, k: int):
        self.q, self.rows, self.k, self.norm = q, rows, k, np.sqrt(_square(q))
        #: The kth score known so far and its id, from other shards at first.
        self.kth, self.kth_id = score.copy(), least.copy()
        self.found = [np.zeros(0, np.int64)] * 3

    def beats(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (score > self.kth[query]) | ((score == self.kth[query]) & (ids <= self.kth_id[query]))

    def visit(self, tree: Tree, query: np.ndarray, node: np.ndarray) -> None:
        """Score the rows of leaves for queries (pairs), and raise the kth scores."""
        got = [self.found]
        order = np.argsort(node, kind="stable")
        query, node = query[order], node[order]
        for some in np.split(np.arange(len(node)), np.flatnonzero(np.diff(node)) + 1) if len(node) else []:
            a, b = tree.span[node[some[0]]]
            mine = query[some]
            score = _scores(self.q[mine], tree.x[a:b], float(self.norm[mine].max(initial=0)) * tree.size[node[some[0]]] * 1.001)
            i, j = np.nonzero((score >= self.kth[mine][:, None]) & (tree.rows[a:b][None, :] != self.rows[mine][:, None]))
            got.append([mine[i], score[i, j], tree.ids[a:b][j]])
        query, score, ids = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = (place < self.k) & self.beats(query, score, ids)
        self.found = [query[keep], score[keep], ids[keep]]
        last = np.flatnonzero(place == self.k - 1)  # k rows are at least as good
        better = last[(score[last] > self.kth[query[last]]) | ((score[last] == self.kth[query[last]]) & (ids[last] < self.kth_id[query[last]]))]
        self.kth[query[better]], self.kth_id[query[better]] = score[better], ids[better]

    def open(self, tree: Tree, query: np.ndarray, node: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Pairs whose node may hold a row that beats the query's kth."""
        kth = self.kth[query].astype(float)
        slack = np.abs(kth) * 1e-15
        return (top > kth + slack) | ((top >= kth - slack) & (tree.least[node] <= self.kth_id[query]))

    def run(self, tree: Tree) -> None:
        n = len(self.q)
        first = np.zeros(n, np.int64)
        for _ in range(tree.depth):  # the leaf with the best bound on the way down
            left, right = 2 * first + 1, 2 * first + 2
            first = np.where(tree.bound(self.q, self.norm, left) >= tree.bound(self.q, self.norm, right), left, right)
        self.visit(tree, np.arange(n), first)
        query, node = np.arange(n), np.zeros(n, np.int64)
        top = tree.bound(self.q, self.norm, node)
        for level in range(tree.depth + 1):
            keep = self.open(tree, query, node, top)
            query, node, top = query[keep], node[keep], top[keep]
            if level < tree.depth:
                query, node = np.repeat(query, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
                top = tree.bound(self.q[query], self.norm[query], node)
        fresh = node != first[query]
        query, node, top = query[fresh], node[fresh], top[fresh]
        order = np.lexsort((-top, query))
        query, node, top = query[order], node[order], top[order]
        step = 1
        while len(query):  # the next leaves of every query by falling bound
            place = np.arange(len(query)) - np.searchsorted(query, query)
            now = place < step
            self.visit(tree, query[now], node[now])
            query, node, top = query[~now], node[~now], top[~now]
            keep = self.open(tree, query, node, top)
            query, node, top = query[keep], node[keep], top[keep]
            step *= 2


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as double; null for vectors that take no part."""
    real = vector.cast("array<double>")
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # a double from 2^52 on is whole already, and FLOOR would turn it into a long
    scaled = F.transform(real, lambda x: F.when(F.abs(x * scale) < F.lit(float(1 << 52)), F.floor(x * scale).cast("double")).otherwise(x * scale))
    over = F.exists(scaled, lambda x: F.abs(x) == F.lit(float("inf")))
    return F.when(vector.isNotNull() & ~bad & ~over, scaled)


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of an array column that all have the same length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(flat) else np.zeros((len(col), 0))


def _searched(batches, k: int, leaf: int):
    """Groups of adjacent rows (one shard and query block each), the shard's rows before the queries."""
    key, parts, tree = None, [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = np.stack([table.column(c).to_numpy() for c in ("dim", "shard", "block", "asks")], 1)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if b == a:
                continue
            if key != tuple(keys[a, :3]):
                key, parts, tree = tuple(keys[a, :3]), [], None
            part = table.slice(a, b - a)
            if not keys[a, 3]:
                parts.append(part)
                continue
            if tree is None:
                if not parts:
                    continue
                own = pa.concat_tables(parts)
                parts, tree = [], Tree(_matrix(own.column("v")), own.column("id").to_numpy(), own.column("row").to_numpy(), leaf)
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                rows, ids = some.column("row").to_numpy(), some.column("id").to_numpy()
                s = Search(_matrix(some.column("v")), rows, some.column("kth").to_numpy(), some.column("kth_id").to_numpy(), k)
                s.run(tree)
                query, score, found = s.found
                yield pa.RecordBatch.from_arrays([pa.array(rows[query]), pa.array(ids[query]), pa.array(found), pa.array(score)], ["row", "query_id", "vec_id", "score"])


_FOUND = "row long, query_id long, vec_id long, score long"


def _round(shards: DataFrame, queries: DataFrame, k: int, leaf: int) -> DataFrame:
    """Candidates of each query from each shard it is sent to."""
    columns = ["dim", "shard", "block", "asks", "row", "id", "v", "kth", "kth_id"]
    both = shards.withColumns({"asks": F.lit(0), "kth": F.lit(int(_NONE)).cast("long"), "kth_id": F.lit(int(_LONG)).cast("long")}).select(columns).unionByName(
        queries.withColumn("asks", F.lit(1)).select(columns))
    dealt = both.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "asks")
    return dealt.mapInArrow(lambda batches: _searched(batches, k, leaf), _FOUND)


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding",
          shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query, equal scores by smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows, those
    that repeat the query's id included.  Rows without an id and vectors that are null or hold null or
    non-finite components (before or after scaling) take no part; vectors of different lengths are
    not compared, those of length 0 score 0 with each other.  Scores beyond the range of longs are held to it."""
    ship(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v")).where("id is not null and v is not null")
    rows = cut_lineage(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("v").alias("dim"), "v"), "vectors")
    asks = F.pmod(F.col("id"), F.lit(every)) == 0
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("m"))
    # one row for each length of vectors; a join, since nothing bounds their number
    rows = rows.join(sizes.select("dim", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int").alias("blocks")), "dim")
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"), "own_block": F.pmod(F.xxhash64("row", F.lit("block")), F.col("blocks")).cast("int")})
    nothing = {"kth": F.lit(int(_NONE)).cast("long"), "kth_id": F.lit(int(_LONG)).cast("long")}
    queries = rows.where(asks).withColumnRenamed("own_block", "block")
    first = cut_lineage(_round(rows.withColumn("block", F.lit(0)), queries.withColumn("block", F.lit(0)).withColumns(nothing), k, leaf), "found")
    kth = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best")).select(
        "row", F.when(F.size("best") >= k, F.element_at("best", -1)["s"]).alias("s"), F.when(F.size("best") >= k, F.element_at("best", -1)["vec_id"]).alias("kth_id"))
    known = queries.join(kth, "row", "left").withColumns({"kth": F.coalesce(-F.col("s"), nothing["kth"]), "kth_id": F.coalesce("kth_id", nothing["kth_id"])})
    away = known.withColumnRenamed("shard", "home").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard <> home")
    replicas = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    second = _round(replicas, away, k, leaf)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
