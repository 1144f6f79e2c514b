"""Mutual-information feature ranking and drift between splits or runs.

Both work on counts that are merged before they are shuffled: joint histograms over quantile bins, and value
counts with running sums over value ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthkit.functions.quantiles import PIECES, sums_before, value_range, group_quantiles
from depthkit.session import cut_lineage


def _stacked(df: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """(feature, x, keep) of all columns; rows are only multiplied on the way to an aggregate."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    return df.select(*keep, cells.alias("_s")).select("_s.feature", "_s.x", *[F.col(k) for k in df.select(*keep).columns])


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Inner quantile edges of each column: bins - 1 numbers a column."""
    qs = [i / bins for i in range(1, bins)]
    rows = group_quantiles(_stacked(df, columns), ["feature"], "x", qs, [f"e{i}" for i in range(1, bins)]).collect()
    return {r["feature"]: [v for v in r[1:] if v is not None] for r in rows}


def _bin(x: Column, edges: list[float]) -> Column:
    """Number of edges below a value."""
    return sum(((x > F.lit(e)).cast("int") for e in edges), F.lit(0))


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, n, mi, rank): mutual information (nats) of each feature with the target, both cut at their quantiles.

    Rows count where both have a value; equal scores rank by name.  A feature without any such row has 0."""
    features = list(features)
    edges = bin_edges(df, [*features, target], bins)
    y = F.when(F.col(target).isNotNull(), _bin(F.col(target).cast("double"), edges.get(target, [])))
    binned = df.select(*[F.when(F.col(c).isNotNull(), _bin(F.col(c).cast("double"), edges.get(c, []))).alias(c) for c in features], y.alias("_y"))
    joint = _stacked(binned, features, F.col("_y")).filter("x is not null and _y is not null").groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("feature")  # at most bins * bins rows of a feature
    n, nx, ny = F.sum("k").over(w), F.sum("k").over(Window.partitionBy("feature", "x")), F.sum("k").over(Window.partitionBy("feature", "_y"))
    cells = joint.withColumns({"n": n, "nx": nx, "ny": ny})
    per = cells.groupBy("feature").agg(F.max("n").alias("n"), F.sum(F.col("k") / F.col("n") * F.ln(F.col("k") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"))
    every = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")  # a row per feature
    out = every.join(per, "feature", "left").select("feature", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("mi", F.lit(0.0)).alias("mi"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("mi", 9)), "feature")))


def drift(df: DataFrame, curves: Sequence[str], part: str, reference: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(curve, part, n, n_reference, ks, psi) of every part of a table against its reference part.

    ``ks``: largest distance of the two cumulative distributions; ``psi``: population stability index
    over the reference's quantile bins, shares held to at least ``floor``.  Both are NULL where a side has no
    values; rows without a part are left out."""
    curves = list(curves)
    cells = _stacked(df.filter(F.col(part).isNotNull()), curves, F.col(part).cast("string").alias("part")).withColumnRenamed("feature", "curve").filter("x is not null")
    runs = cut_lineage(cells.groupBy("curve", "part", "x").agg(F.count(F.lit(1)).alias("c")), "drift-runs")  # read by every step below
    totals = runs.groupBy("curve", "part").agg(F.sum("c").alias("n"))
    ref = totals.filter(F.col("part") == reference).select("curve", F.col("n").alias("n_reference"))
    wanted = df.select(F.col(part).cast("string").alias("part")).distinct().filter(F.col("part").isNotNull() & (F.col("part") != reference)).select(
        "part", F.explode(F.array(*[F.lit(c) for c in curves])).alias("curve"))
    pairs = wanted.join(totals, ["curve", "part"], "left").join(ref, "curve", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "n_reference")})

    # the reference's runs meet those of each part, value by value, in value ranges with running offsets
    pairs = cut_lineage(pairs, "drift-pairs")  # a row per curve and part
    live = pairs.filter("n > 0 and n_reference > 0")
    own = runs.join(live, ["curve", "part"]).select("curve", "part", "x", F.col("c").alias("a"), F.lit(0).cast("long").alias("b"))
    base = runs.filter(F.col("part") == reference).drop("part").join(live.select("curve", "part"), "curve").select(
        "curve", "part", "x", F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))
    both = own.unionByName(base).groupBy("curve", "part", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("_b", value_range(F.col("x"), PIECES))
    both = cut_lineage(both, "drift-runs")
    ranges = both.groupBy("curve", "part", "_b").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    ranges = ranges.withColumns({"oa": sums_before(["curve", "part"], "_b", F.col("ta")), "ob": sums_before(["curve", "part"], "_b", F.col("tb"))})
    w = Window.partitionBy("curve", "part", "_b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    at = both.join(ranges.drop("ta", "tb"), ["curve", "part", "_b"]).withColumns({"fa": F.col("oa") + F.sum("a").over(w), "fb": F.col("ob") + F.sum("b").over(w)})
    ks = at.join(live, ["curve", "part"]).groupBy("curve", "part").agg(F.max(F.abs(F.col("fa") / F.col("n") - F.col("fb") / F.col("n_reference"))).alias("ks"))

    edges = bin_edges(df.filter(F.col(part) == reference), curves, bins)
    number = F.lit(None).cast("int")
    for c in curves:
        number = F.when(F.col("curve") == c, _bin(F.col("x"), edges.get(c, []))).otherwise(number)
    shares = both.withColumn("bin", number).groupBy("curve", "part", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    every = live.withColumn("bin", F.explode(F.array(*[F.lit(i) for i in range(bins)])))
    shares = every.join(shares, ["curve", "part", "bin"], "left")
    share = lambda k, n: F.greatest(F.coalesce(F.col(k), F.lit(0)) / F.col(n), F.lit(floor))
    p, q = share("a", "n"), share("b", "n_reference")
    psi = shares.groupBy("curve", "part").agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))
    return pairs.join(ks, ["curve", "part"], "left").join(psi, ["curve", "part"], "left").select("curve", "part", "n", "n_reference", "ks", "psi")
