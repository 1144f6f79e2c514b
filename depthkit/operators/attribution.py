"""Sampled Shapley attribution of a model's predictions (M9, A22) and its summaries.

A row's attribution to a feature is the mean change of the prediction when the feature joins, over
seeded orders of the features; each order is also used backwards (antithetic), which cancels much of the
sampling error.  All hybrid rows of all orders (features joined so far from the row, the others from a
background) are one frame, which the model scores in one job.  For every order the changes
add up to prediction minus background prediction, and so do the attributions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name parts of the second taxonomy of features.  A feature may be in several groups.
ATTRIBUTION_GROUPS = {
    "rolling": ["roll_"],
    "indicators": ["is_", "gr_", "in_depth_window"],
    "gradient": ["gradient", "diff", "pct_change"],
    "depth": ["depth"],
    "cross_curve": ["ROP", "TVD", "VS", "TEMP"],
    "curvature": ["curvature"],
}


def feature_orders(n: int, orders: int = 8, seed: int = 42) -> list[list[int]]:
    """Places of the features in each order: seeded permutations, each followed by its reverse."""
    rng, out = np.random.RandomState(seed), []
    for _ in range(max(1, orders // 2)):
        place = [0] * n
        for k, f in enumerate(rng.permutation(n)):
            place[f] = k
        out += [place, [n - 1 - p for p in place]]
    return out


def background_row(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """The features' means: one row."""
    r = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    return {c: float(r[c]) if r[c] is not None else 0.0 for c in features}


def sampled_shapley(df: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], key: Sequence[str],
                    keep: Sequence[str] = (), background: dict[str, float] | None = None, orders: int = 8, seed: int = 42) -> DataFrame:
    """(key, keep, feature, attribution, base, prediction), a row per row of ``df`` and feature.

    ``predict`` adds ``prediction`` to a frame with the features and keeps its other columns; ``key`` names a
    row.  ``base`` is the prediction of the background (the means if none is given)."""
    features, n = list(features), len(features)
    background = background or background_row(df, features)
    places = F.array(*[F.struct(F.lit(o).alias("o"), F.array(*[F.lit(p) for p in place]).alias("place")) for o, place in enumerate(feature_orders(n, orders, seed))])
    rows = df.select(*key, *keep, *features).withColumn("_order", F.explode(places)).withColumn("_step", F.explode(F.array(*[F.lit(i) for i in range(n + 1)])))
    hybrid = {c: F.when(F.col("_order.place")[i] < F.col("_step"), F.col(c).cast("double")).otherwise(F.lit(background[c])) for i, c in enumerate(features)}
    scored = predict(rows.withColumns(hybrid)).select(*key, *keep, "_order", "_step", F.col("prediction").cast("double").alias("_p"))
    walk = scored.groupBy(*key, *keep, "_order").agg(F.sort_array(F.collect_list(F.struct("_step", "_p"))).alias("_w"))  # n + 1 steps
    value = lambda at: F.element_at("_w", at)["_p"]
    change = [(value(F.col("_order.place")[i] + 2) - value(F.col("_order.place")[i] + 1)).alias(f"_c{i}") for i in range(n)]
    mean = walk.select(*key, *keep, value(F.lit(1)).alias("base"), value(F.lit(-1)).alias("prediction"), *change).groupBy(*key, *keep).agg(
        F.avg("base").alias("base"), F.avg("prediction").alias("prediction"), *[F.avg(f"_c{i}").alias(f"_c{i}") for i in range(n)])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("attribution")) for i, c in enumerate(features)]))
    return mean.select(*key, *keep, long.alias("_f"), "base", "prediction").select(*key, *keep, "_f.feature", "_f.attribution", "base", "prediction")


def groups_of(feature: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """The taxonomy's groups that a feature name belongs to."""
    groups = groups or ATTRIBUTION_GROUPS
    hits = []
    for name, parts in groups.items():
        found = F.lit(False)
        for part in parts:
            found = found | feature.contains(part)
        hits.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*hits))


def summary(long: DataFrame, flags: Sequence[str] = (), groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(kind, name, part, features, total): mean absolute attributions from the long table.

    ``kind`` ``feature``: of each feature; ``group``: summed over the features of each group of the second taxonomy, 0 if
    it has none; ``flag``: of each feature over the rows where a 0/1 flag (a column of the table) is 1, ``part``
    naming the flag."""
    groups = groups or ATTRIBUTION_GROUPS
    size = F.abs("attribution")
    per = long.groupBy("feature").agg(F.avg(size).alias("total"))
    out = per.select(F.lit("feature").alias("kind"), F.col("feature").alias("name"), F.lit(None).cast("string").alias("part"), F.lit(1).cast("long").alias("features"), "total")
    spark = long.sparkSession
    names = spark.createDataFrame([(g,) for g in groups], "name string")
    sums = per.select(F.explode(groups_of(F.col("feature"), groups)).alias("name"), "total").groupBy("name").agg(F.count(F.lit(1)).alias("features"), F.sum("total").alias("total"))
    sums = names.join(F.broadcast(sums), "name", "left")  # a row per group
    out = out.unionByName(sums.select(F.lit("group").alias("kind"), "name", F.lit(None).cast("string").alias("part"),
                                      F.coalesce("features", F.lit(0).cast("long")).alias("features"), F.coalesce("total", F.lit(0.0)).alias("total")))
    if flags:
        wide = long.groupBy("feature").agg(*[F.avg(F.when(F.col(f) == 1, size)).alias(f) for f in flags])
        parts = F.explode(F.array(*[F.struct(F.lit(f).alias("part"), F.col(f).alias("total")) for f in flags]))
        out = out.unionByName(wide.select(F.lit("flag").alias("kind"), F.col("feature").alias("name"), parts.alias("_p")).select(
            "kind", "name", "_p.part", F.lit(1).cast("long").alias("features"), "_p.total"))
    return out
