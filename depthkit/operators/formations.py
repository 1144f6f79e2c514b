"""Interval join of depths to formation tops, and statistics per formation.

A table of tops has a row per (well, formation) with its top and base depth; a missing top or base is
open.  Intervals may overlap, so a row may be in several formations or in none.  The join is by equality: an
interval is listed once for every depth bucket it touches, a row knows its own bucket, and the exact limits
are checked on the pairs that meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.operators.blocked import join_null_safe

#: Tasks that the rows of one (well, bucket) are dealt to; the intervals, of which there are few, are repeated.
SALTS = 8


def in_formations(df: DataFrame, tops: DataFrame, group: str = S.GROUP, order: str = S.ORDER, formation: str = "formation",
                  top: str = "top", base: str = "base", bucket: float = 100.0, salts: int = SALTS) -> DataFrame:
    """``df`` with ``formation``, a row for each interval [top, base) that holds its depth, and one with NULL if none does.

    A missing top lies above, a missing base below all depths; an interval whose base is not below
    its top holds nothing.  Rows without a depth are in no formation; rows without a group are a group."""
    span = df.groupBy(group).agg(F.min(order).alias("_mn"), F.max(order).alias("_mx"))
    t = join_null_safe(tops.select(group, F.col(formation).alias("_f"), F.col(top).cast("double").alias("_top"), F.col(base).cast("double").alias("_base")), span, [group])
    t = t.filter(F.col("_mn").isNotNull() & (F.col("_top").isNull() | F.col("_base").isNull() | (F.col("_top") < F.col("_base"))))
    lo, hi = F.greatest(F.coalesce("_top", "_mn"), "_mn"), F.least(F.coalesce("_base", "_mx"), "_mx")  # only depths that occur
    number = lambda d: F.floor(d / F.lit(float(bucket))).cast("long")
    t = t.filter(lo <= hi).select(group, "_f", "_top", "_base", F.explode(F.sequence(number(lo), number(hi))).alias("_b"))
    t = t.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    rows = df.withColumns({"_rid": F.xxhash64(*[F.col(c) for c in df.columns]), "_b": number(F.col(order))})
    rows = rows.withColumn("_salt", F.pmod("_rid", F.lit(salts)).cast("int"))
    r = t.withColumnsRenamed({c: f"_t_{c}" for c in (group, "_b", "_salt")})
    inside = (F.col("_top").isNull() | (F.col(order) >= F.col("_top"))) & (F.col("_base").isNull() | (F.col(order) < F.col("_base")))
    same = rows[group].eqNullSafe(r[f"_t_{group}"]) & (F.col("_b") == F.col("_t__b")) & (F.col("_salt") == F.col("_t__salt")) & inside
    return rows.join(r, same, "left").select(*df.columns, F.col("_f").alias(formation))


def formation_scaled(df: DataFrame, x: str, group: str | None = S.GROUP, formation: str = "formation") -> DataFrame:
    """``<x>_z_formation``, the z-score (sample std) within (group, formation), or within the formation if ``group`` is None."""
    keys = [*([group] if group else []), formation]
    st = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    j = join_null_safe(df, st, keys, "left")
    return j.withColumn(f"{x}_z_formation", F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))).select(*df.columns, f"{x}_z_formation")


def formation_moments(df: DataFrame, curves: Sequence[str], formation: str = "formation", group: str = S.GROUP) -> DataFrame:
    """(formation, curve, wells, n, mean, variance, well_mean_std): moments, and how far the wells' means lie apart."""
    per = df.groupBy(formation, group).agg(*[F.struct(F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("s"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(c) for c in curves])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(c).alias("q")) for c in curves]))
    long = per.select(formation, cells.alias("_c")).select(formation, "_c.curve", "_c.q.*").filter("n > 0")
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    square = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / n
    return long.groupBy(formation, "curve").agg(F.count(F.lit(1)).alias("wells"), n.alias("n"), mean.alias("mean"), (square - mean * mean).alias("variance"),
                                                F.stddev_samp("m").alias("well_mean_std"))
