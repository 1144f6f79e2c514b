"""Exact nearest-donor imputation inside a well (J4, ``mode="knn"``).

A missing value becomes the mean of the k donors (rows of the well that have the curve) that are nearest
in the other curves, standardised by well; a distance uses the curves that both rows have, scaled up to all of
them.  Rows are never paired with all donors of a well.  Donors with the same NULL pattern are put in Z-order
of their standardised curves, and their positions make a tree without a build step: 64 neighbours
are a leaf, 64 leaves a node, and so on.  A node's row holds its number of donors and the smallest and largest
value of each curve, so any query knows a least and a greatest distance to it.  Level by level from the top, a
query keeps the nodes that may hold one of its k nearest: those not farther at least than the
distance within which the other nodes surely hold k donors.  Only the donors of the leaves that
are left are compared, a leaf's with a query in one row, which keeps the k nearest of them, so that pairs are not shuffled.

Wells of at most ``SMALL`` rows need no tree: ``knn_impute`` brings the rows of such a well together once, fills all
curves there and passes the rows on.  A task holds one such well at a time, so it stays bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.llm.base import ship
from depthkit.operators.blocked import join_null_safe, series_index
from depthkit.session import cut_lineage

FAN = 64
#: Most rows of a well that is filled in one task.
SMALL = 4096
#: Pairs that are compared at once there.
_PAIRS = 1 << 18
#: Bits of a coordinate in the Z-order, and the coordinates that take part: they decide how well nodes prune, not what is found.
BITS, AXES = 10, 6
#: Squared distances are compared by their first 9 decimals, so that equal ones stay equal whatever the order of sums.
_DIGITS = 9
_SLACK = 1e-8


def _standardised(df: DataFrame, curve: str, predictors: Sequence[str], group: str, min_share: float) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_z`` (standardised predictors, NULL where missing or not available in the well), ``_dim``, ``_pattern``; and the wells."""
    n = F.count(F.lit(1))
    well = df.groupBy(group).agg(n.alias("_rows"), *[(F.count(c) > n * min_share).alias(f"_av_{c}") for c in predictors],
                                 *[F.avg(c).alias(f"_m_{c}") for c in predictors], *[F.stddev_pop(c).alias(f"_s_{c}") for c in predictors])
    j = join_null_safe(df, well, [group])
    z = [F.when(F.col(f"_av_{c}"), (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))) for c in predictors]
    j = j.select("_id", group, "_at", "_tie", F.col(curve).cast("double").alias("_y"), F.array(*z).alias("_z"),
                 sum((F.col(f"_av_{c}").cast("int") for c in predictors), F.lit(0)).alias("_dim"))
    j = j.withColumn("_pattern", F.array_join(F.transform("_z", lambda x: F.when(x.isNull(), "0").otherwise("1")), ""))
    return j, well


def _zorder(z: Column, d: int) -> Column:
    """Interleaved bits of the first coordinates, within four deviations of the mean."""
    axes = [F.least(F.greatest(F.floor((F.coalesce(z[i], F.lit(0.0)) + 4) * ((1 << BITS) / 8.0)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long") for i in range(min(d, AXES))]
    out = F.lit(0).cast("long")
    for bit in range(BITS - 1, -1, -1):
        for a in axes:
            out = out * 2 + F.shiftright(a, bit).bitwiseAND(F.lit(1))
    return out


def _bounds(d: int) -> tuple[Column, Column, Column]:
    """Least and greatest squared distance of the query ``_z`` to a node with ``_lo`` and ``_hi``, and the curves they share."""
    low, high, shared = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i in range(d):
        x, lo, hi = F.col("_z")[i], F.col("_lo")[i], F.col("_hi")[i]
        both = x.isNotNull() & lo.isNotNull()
        gap, far = F.greatest(lo - x, x - hi, F.lit(0.0)), F.greatest(F.abs(x - lo), F.abs(x - hi))
        low, high = low + F.when(both, gap * gap).otherwise(0.0), high + F.when(both, far * far).otherwise(0.0)
        shared = shared + both.cast("int")
    return low, high, shared


def _kept(frontier: DataFrame, d: int) -> DataFrame:
    """Of (query, node) pairs, those whose node may hold one of the query's ``_k`` nearest donors."""
    low, high, shared = _bounds(d)
    f = frontier.withColumn("_s", shared).filter(F.col("_s") > 0).withColumns({"_low": low * F.col("_dim") / F.col("_s"), "_high": high * F.col("_dim") / F.col("_s")})
    w = Window.partitionBy("_id").orderBy("_high", "_pattern_d", "_node").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_sure", F.sum("_count").over(w))
    reach = F.min(F.when(F.col("_sure") >= F.col("_k"), F.col("_high"))).over(Window.partitionBy("_id"))
    f = f.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("_low") <= F.col("_reach") * (1 + _SLACK) + _SLACK))
    return f.select("_id", "_z", "_dim", "_k", "_well", "_pattern_d", "_node")


def nearest_donors(df: DataFrame, curve: str, predictors: Sequence[str], k: int = 5, min_usable_rows: int = S.MIN_USABLE_ROWS,
                   min_share: float = 0.5, group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None) -> DataFrame:
    """(_id, rank, _y, d2) of the donors of each row of ``df`` (which has a row number ``_id``) whose curve is missing.

    Predictors that have a value in more than ``min_share`` of a well's rows take part there.  A well needs more
    than ``min_usable_rows`` donors; k is at most half of them.  Equal distances go to the smaller
    ``order`` (then ``tie``)."""
    d = len(predictors)
    rows = df.withColumns({"_at": F.col(order), "_tie": F.col(tie) if tie else F.lit(0)})
    rows, _ = _standardised(rows, curve, predictors, group, min_share)
    rows = cut_lineage(rows.filter(F.col("_pattern").contains("1")).withColumn("_well", F.struct(F.col(group).alias("w"))).drop(group), "knn-rows")
    donors = rows.filter("_y is not null")
    ks = donors.groupBy("_well").agg(F.count(F.lit(1)).alias("_n_donors")).filter(F.col("_n_donors") > min_usable_rows).select(
        "_well", F.greatest(F.lit(1), F.least(F.lit(k), F.floor(F.col("_n_donors") / 2))).cast("int").alias("_k"))
    queries = rows.filter("_y is null").join(ks, "_well").select("_id", "_z", "_dim", "_k", "_well")

    donors = donors.withColumns({"_grp": F.struct("_well", "_pattern"), "_code": _zorder(F.col("_z"), d)})
    placed, sizes = series_index(donors.select("_grp", "_code", "_id", "_at", "_tie", "_y", "_z"), "_grp", "_code")
    placed = cut_lineage(placed.select(F.col("_grp._well").alias("_well"), F.col("_grp._pattern").alias("_pattern_d"), F.floor(F.col("_idx") / FAN).cast("long").alias("_node"),
                                       F.col("_id").alias("_donor"), "_at", "_tie", "_y", F.col("_z").alias("_zd")), "knn-donors")
    most = sizes.agg(F.max("_n")).first()[0] or 0
    edges = lambda lo, hi: [F.array(*[f(F.col(c)[i]) for i in range(d)]).alias(n) for c, n, f in ((lo, "_lo", F.min), (hi, "_hi", F.max))]
    levels = [cut_lineage(placed.groupBy("_well", "_pattern_d", "_node").agg(F.count(F.lit(1)).alias("_count"), *edges("_zd", "_zd")), "knn-nodes")]
    while most > FAN * FAN:  # until the nodes of any well and pattern are at most FAN
        below = levels[-1]
        levels.append(cut_lineage(below.withColumn("_node", F.floor(F.col("_node") / FAN).cast("long")).groupBy("_well", "_pattern_d", "_node").agg(
            F.sum("_count").alias("_count"), *edges("_lo", "_hi")), "knn-nodes"))
        most //= FAN
    frontier = _kept(queries.join(levels[-1], "_well"), d)
    for nodes in levels[-2::-1]:
        children = nodes.withColumn("_parent", F.floor(F.col("_node") / FAN).cast("long"))
        frontier = _kept(frontier.withColumnRenamed("_node", "_parent").join(children, ["_well", "_pattern_d", "_parent"]), d)
    # a leaf is one row with its donors, FAN at most, and each (query, leaf) row keeps the query's nearest of them
    leaves = placed.groupBy("_well", "_pattern_d", "_node").agg(F.collect_list(F.struct("_at", "_tie", "_donor", "_y", "_zd")).alias("_donors"))

    def compared(donor: Column) -> Column:
        total, shared = F.lit(0.0), F.lit(0)
        for i in range(d):
            gap = F.col("_z")[i] - donor["_zd"][i]
            total, shared = total + F.coalesce(gap * gap, F.lit(0.0)), shared + gap.isNotNull().cast("int")
        return F.struct(F.round(total * F.col("_dim") / shared, _DIGITS).alias("d2"), *[donor[c].alias(c) for c in ("_at", "_tie", "_donor", "_y")])

    best = F.slice(F.array_sort(F.transform("_donors", compared)), F.lit(1), F.col("_k"))
    pairs = frontier.join(leaves, ["_well", "_pattern_d", "_node"]).select("_id", "_k", F.inline(best))
    near = Window.partitionBy("_id").orderBy("d2", "_at", "_tie", "_donor")
    return pairs.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= F.col("_k")).select("_id", "rank", "_y", "d2")


def _fills(y: np.ndarray, known: np.ndarray, z: list[np.ndarray], has: list[np.ndarray], k: int, min_usable_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Fills of one well's curve by row, and which rows have none.  ``z``, ``has``: values and presence of its available predictors.

    Rows are in the order that decides between equal distances."""
    out, none = np.zeros(len(y)), np.ones(len(y), bool)
    some = np.any(has, axis=0) if has else np.zeros(len(y), bool)
    donors, queries = np.flatnonzero(known & some), np.flatnonzero(~known & some)
    if len(donors) <= min_usable_rows or not len(queries):
        return out, none
    k, own = max(1, min(k, len(donors) // 2)), y[donors]
    step = max(1, _PAIRS // len(donors))
    for a in range(0, len(queries), step):
        q = queries[a:a + step]
        total, shared = np.zeros((len(q), len(donors))), np.zeros((len(q), len(donors)), np.int64)
        with np.errstate(all="ignore"):
            for v, h in zip(z, has):
                both, gap = h[q][:, None] & h[donors], v[q][:, None] - v[donors]
                total += np.where(both, gap * gap, 0.0)
                shared += both
            d2 = np.round(total * len(z) / shared, _DIGITS)
        d2 = np.where(shared > 0, np.where(np.isfinite(d2), d2, np.finfo(float).max), np.inf)  # no curve in common: never taken
        last = np.partition(d2, k - 1, axis=1)[:, k - 1:k]
        near, tied = d2 < last, (d2 == last) & (d2 < np.inf)
        take = near | tied & (np.cumsum(tied, axis=1) <= k - near.sum(1, keepdims=True))
        n = take.sum(1)
        out[q], none[q] = np.where(take, own, 0.0).sum(1) / np.maximum(n, 1), n == 0
    return out, none


def _fill_small(df: DataFrame, curves: Sequence[str], predictors: Sequence[str], k: int, min_usable_rows: int, min_share: float,
                group: str, order: str, tie: str | None) -> DataFrame:
    """``df``, whose wells have at most ``SMALL`` rows, with ``_fill_<i>`` for each curve."""
    well = Window.partitionBy(group)
    names = list(dict.fromkeys(predictors))
    own = [c for c in df.columns if c != "_id"]
    cols = {"_at": F.row_number().over(well.orderBy(F.col(order), *([F.col(tie)] if tie else []), F.col("_id")))}
    for i, c in enumerate(names):
        s = F.stddev_pop(c).over(well)
        cols[f"_z{i}"] = F.when(F.count(c).over(well) > F.count(F.lit(1)).over(well) * min_share,
                                (F.col(c) - F.avg(c).over(well)) / F.when(s == 0, 1.0).otherwise(s)).cast("double")
        cols[f"_av{i}"] = F.count(c).over(well) > F.count(F.lit(1)).over(well) * min_share
    for i, c in enumerate(curves):
        cols[f"_y{i}"] = F.col(c).cast("double")
    ready = df.withColumns(cols).select(*own, *cols)
    ship(df.sparkSession)
    used = [[names.index(p) for p in predictors if p != c] for c in curves]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("_at").to_numpy(), kind="stable")))

        def values(name: str) -> tuple[np.ndarray, np.ndarray]:
            col = table.column(name)
            return col.fill_null(0.0).to_numpy(), ~col.is_null().to_numpy()

        here = {i: values(f"_z{i}") for i in range(len(names)) if table.column(f"_av{i}")[0].as_py()}
        out = table.select(own)
        for i in range(len(curves)):
            z = [here[j] for j in used[i] if j in here]
            fill, none = _fills(*values(f"_y{i}"), [v for v, _ in z], [h for _, h in z], k, min_usable_rows)
            out = out.append_column(f"_fill_{i}", pa.array(fill, pa.float64(), mask=none))
        return out

    fields = df.select(*own).schema
    for i in range(len(curves)):
        fields = fields.add(f"_fill_{i}", "double")
    return ready.groupBy(group).applyInArrow(run, fields)


def knn_impute(df: DataFrame, curves: Sequence[str], predictors: Sequence[str] | None = None, k: int = 5, min_usable_rows: int = S.MIN_USABLE_ROWS,
               min_share: float = 0.5, group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None) -> DataFrame:
    """Each curve's missing values from the nearest donors in the other curves as they are in ``df``.

    A row without any available predictor, or in a well with too few donors, keeps its NULL.  Rows
    without a group are a well."""
    base = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()), "knn-input")
    wells = cut_lineage(base.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")), "knn-wells")
    large = wells.filter(F.col("_rows") > SMALL).select(group)
    some_large = not large.isEmpty()
    small = base.join(large.withColumnRenamed(group, "_large"), base[group].eqNullSafe(F.col("_large")), "left_anti") if some_large else base
    out = _fill_small(small, curves, list(predictors or curves), k, min_usable_rows, min_share, group, order, tie)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{i}")) for i, c in enumerate(curves)}).select(*df.columns)
    if not some_large:
        return out
    base = rest = join_null_safe(base, large, [group], "left_semi")
    for c in curves:
        found = nearest_donors(base, c, [p for p in (predictors or curves) if p != c], k, min_usable_rows, min_share, group, order, tie)
        means = found.groupBy("_id").agg(F.avg("_y").alias("_fill"))
        rest = rest.join(means, "_id", "left").withColumn(c, F.coalesce(F.col(c), F.col("_fill"))).drop("_fill")
    return rest.select(*df.columns).unionByName(out)
