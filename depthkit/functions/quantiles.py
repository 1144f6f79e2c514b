"""Exact group quantiles from value counts, by one plan at every size.

No task sees a whole group and nothing is sketched or counted beforehand:

1. rows become runs (key, value, count): one partial aggregate, so tied values, however many, are
   one row for each task before the shuffle and one row after it;
2. runs are summed up in value ranges, first in pieces of an octave (``PIECES`` of each power of
   two), and running offsets over the small (key, range) table tell which ranges hold the wanted
   ranks, the order statistics at ``floor/ceil((n-1)q)``;
3. those ranges are cut again, linearly between their own smallest and largest value into
   ``FINE`` ranges, in the same way;
4. only the runs of the ranges left are put in order, and a running sum of their counts finds the values.

The two order statistics are interpolated linearly, the definition used by ``percentile`` and
``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges of an octave at the first level, and of such a range at the second.
PIECES = 256
FINE = 1 << 16
_TOP = 1 << 40


def value_range(v: Column, pieces: int) -> Column:
    """Number of the value range of ``v``: never falls as ``v`` rises; null for null."""
    size = F.abs(v)
    octave = F.floor(F.log2(size) * pieces) + 1100 * pieces  # of the smallest double: above 0
    part = F.when(v == 0, 0).when(size == float("inf"), _TOP).otherwise(octave)
    return F.when(F.isnan(v), 2 * _TOP).otherwise(F.when(v < 0, -part).otherwise(part)).cast("long")


def _within(ranks: str, start: Column, rows: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= start) & (r < start + rows))


def sums_before(part: str | Sequence[str], order: str, rows: Column) -> Column:
    """Sum of ``rows`` over the earlier rows."""
    keys = [part] if isinstance(part, str) else list(part)
    return F.coalesce(F.sum(rows).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    qs: Sequence[float],
    names: Sequence[str] | None = None,
    accuracy: int | None = None,
    count_name: str | None = None,
) -> DataFrame:
    """One row per group: ``keys`` + one column per quantile (NULL for groups without values).

    Rows with a null key are a group; without keys the table is one.  ``accuracy`` is the number of value
    ranges of an octave (``PIECES``): the result is exact with any.  ``count_name`` adds the number of values."""
    keys = list(keys)
    qs = [float(q) for q in qs]
    names = list(names) if names is not None else [f"q{int(round(q * 100))}" for q in qs]
    v = F.col(value) if isinstance(value, str) else value
    key = F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.lit(0)  # a struct compares null keys as equal
    runs = df.select(key.alias("_key"), v.cast("double").alias("_v")).groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c"))
    runs = runs.withColumn("_b", value_range(F.col("_v"), accuracy or PIECES))

    valid = F.when(F.col("_b").isNotNull(), F.col("_t"))
    wide = runs.groupBy("_key", "_b").agg(F.sum("_c").alias("_t"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wide = wide.withColumns({"_n": F.coalesce(F.sum(valid).over(Window.partitionBy("_key")), F.lit(0).cast("long")), "_off": sums_before("_key", "_b", valid)})
    places = [(F.col("_n") - 1) * F.lit(q) for q in qs]
    ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in places for f in (F.floor, F.ceil)]))
    wide = wide.withColumn("_ranks", ranks).withColumn("_ranks", F.when(F.col("_b").isNotNull(), _within("_ranks", F.col("_off"), F.col("_t"))))
    groups = wide.groupBy("_key").agg(F.max("_n").alias("_n"))

    some = wide.filter(F.size("_ranks") > 0).select(F.struct("_key", "_b").alias("_kb"), "_lo", "_hi", "_off", "_ranks")
    share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    # ranges of ``some`` are never null; a filter here would keep Spark from using the runs' shuffle for both sides
    left = runs.withColumn("_kb", F.struct("_key", "_b")).join(some, "_kb").select(
        "_kb", "_v", "_c", "_off", "_ranks", F.coalesce(F.when(F.col("_hi") > F.col("_lo"), F.floor(F.nanvl(share, F.lit(0.0)) * FINE)), F.lit(0)).alias("_f"))

    fine = left.groupBy("_kb", "_f").agg(F.sum("_c").alias("_t"), F.first("_off").alias("_off"), F.first("_ranks").alias("_ranks"))
    fine = fine.withColumn("_off", F.col("_off") + sums_before("_kb", "_f", F.col("_t")))
    fine = fine.withColumn("_ranks", _within("_ranks", F.col("_off"), F.col("_t"))).filter(F.size("_ranks") > 0)
    last = left.drop("_off", "_ranks").join(fine.drop("_t"), ["_kb", "_f"])
    last = last.withColumn("_off", F.col("_off") + sums_before(["_kb", "_f"], "_v", F.col("_c")))
    found = last.select(F.col("_kb._key").alias("_key"), "_v", F.explode(_within("_ranks", F.col("_off"), F.col("_c"))).alias("_rank"))
    at = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two ranks a quantile

    res = groups.join(at, "_key", "left")
    cols = []
    for h, name in zip(places, names):
        lo, hi, part = F.col("_at")[F.floor(h).cast("long")], F.col("_at")[F.ceil(h).cast("long")], h - F.floor(h)
        cols.append(F.when(F.col("_n") > 0, F.when(part == 0, lo).otherwise(lo + part * (hi - lo))).alias(name))
    return res.select(*[F.col("_key")[k].alias(k) for k in keys], *cols, *([F.col("_n").alias(count_name)] if count_name else []))
