"""Nearest valid rows on both sides, in ordered series of any size (two-sided block carry).

"The last valid value above" and "the next valid value below" look arbitrarily far, so no
halo of neighbour rows can hold them, and a window over a whole series would put a hot well in one task.
Here a series is cut into buckets of neighbours (``blocked.series_buckets``), and three steps find both:

1. inside each (series, bucket), two running windows, one in either direction;
2. per (series, bucket), one summary row with its first and last valid point; over that small
   table a running window carries the last point of all earlier buckets down, and the first point
   of all later buckets up;
3. the carries are joined back and fill in where a bucket has nothing on that side.

The windows, the summary and the join all use the key (series, bucket).  If every series fits in one
bucket, steps 2 and 3 are left out and rows are shuffled once.
Null series are a series; null orders come before all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.operators.blocked import series_buckets, tiebreak

#: Rows of a bucket.
BLOCK_ROWS = 1_000_000
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def _bucketed(df: DataFrame, group: str, order: str, block_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with ``_key``, a struct of the series and the bucket, which compares null series as equal, and whether
    each series is one bucket: then nothing is carried, and rows without an order are in it too."""
    j, st = series_buckets(df, group, order, block_rows)
    single = (st.agg(F.max("_n")).first()[0] or 0) <= block_rows
    bucket = F.lit(0).cast("long") if single else F.col("_bkt")
    return j.withColumn("_key", F.struct(F.col(group).alias("g"), bucket.alias("b"))).drop("_bkt", "_dmin", "_dmax"), single


def _along(*keys: str) -> Window:
    """The buckets of a series in order."""
    return Window.partitionBy("_g").orderBy(*(keys or ("_b",)))


def _carried(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per bucket: the last point of the buckets before it (``_up_<c>``) and the first one of those after it (``_down_<c>``).

    ``points`` has a row per bucket: ``_key``, ``_g``, ``_b``, and ``_last_<c>`` / ``_first_<c>`` of each name."""
    down, up = _along().rowsBetween(*_BEFORE), Window.partitionBy("_g").orderBy(F.desc("_b")).rowsBetween(*_BEFORE)
    return points.withColumns({**{f"_up_{c}": F.last(f"_last_{c}", True).over(down) for c in names},
                               **{f"_down_{c}": F.last(f"_first_{c}", True).over(up) for c in names}})


def neighbours(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with its row position and, for each curve, the nearest rows that have a value.

    Adds ``_idx`` (position in the series, from 0), ``_n`` (rows of the series) and per curve
    ``_prev_<c>`` / ``_next_<c>``: struct(i, d, v) of the nearest row at or before / at or after the row that has a
    value: its position, its ``order`` and the value."""
    t, single = _bucketed(df.withColumn("_tb", tiebreak(df)), group, order, block_rows)
    by = [order, *([tie] if tie else []), "_tb"]
    w = Window.partitionBy("_key").orderBy(*by)
    back = Window.partitionBy("_key").orderBy(F.desc("_r")).rowsBetween(*_SO_FAR)
    t = t.withColumn("_r", F.row_number().over(w).cast("long") - 1)
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_r").alias("i"), F.col(order).cast("double").alias("d"), F.col(c).alias("v"))) for c in curves}
    near = t.withColumns({**{f"_prev_{c}": F.last(point[c], True).over(w.rowsBetween(*_SO_FAR)) for c in curves},
                          **{f"_next_{c}": F.last(point[c], True).over(back) for c in curves}})
    if single:
        return near.withColumn("_idx", F.col("_r")).select(*df.columns, "_n", "_idx", *[f"_{s}_{c}" for c in curves for s in ("prev", "next")])
    # i is unique inside a bucket, so the largest struct is the last point
    summary = t.groupBy("_key").agg(F.count(F.lit(1)).alias("_c"), *[F.max(point[c]).alias(f"_last_{c}") for c in curves],
                                    *[F.min(point[c]).alias(f"_first_{c}") for c in curves])
    summary = summary.withColumns({"_g": F.col("_key.g"), "_b": F.col("_key.b")})
    summary = summary.withColumn("_off", F.coalesce(F.sum("_c").over(_along().rowsBetween(*_BEFORE)), F.lit(0).cast("long")))
    summary = summary.withColumns({f"_{side}_{c}": _moved(f"_{side}_{c}") for c in curves for side in ("last", "first")})
    carry = _carried(summary, curves).select("_key", "_off", *[f"_{s}_{c}" for c in curves for s in ("up", "down")])
    j = near.join(carry, "_key")
    out = {"_idx": F.col("_off") + F.col("_r")}
    for c in curves:
        out[f"_prev_{c}"] = F.coalesce(_moved(f"_prev_{c}"), F.col(f"_up_{c}"))
        out[f"_next_{c}"] = F.coalesce(_moved(f"_next_{c}"), F.col(f"_down_{c}"))
    return j.withColumns(out).select(*df.columns, "_n", *out)


def _moved(point: str) -> Column:
    """A point whose position counts from the start of the series instead of the bucket."""
    p = F.col(point)
    return F.when(p.isNotNull(), F.struct((p["i"] + F.col("_off")).alias("i"), p["d"].alias("d"), p["v"].alias("v")))


def asof_neighbours(df: DataFrame, curves: Sequence[str], probe: str, tie: str, group: str = S.GROUP, order: str = S.ORDER,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``df`` where ``probe`` is true, each with the nearest valid samples by depth.

    Samples are the other rows.  Per curve ``_prev_<c>`` / ``_next_<c>`` is struct(d, v) of the sample at or
    above / at or below the probe's depth, and ``_span_<c>`` struct(lo, hi) holds the depths of the first and last
    valid sample of the series.  Of several samples at one depth, the first valid one in the order of
    ``tie`` counts."""
    t, single = _bucketed(df, group, order, block_rows)
    t = t.withColumn("_p", F.col(probe).cast("int"))
    # samples of a depth in falling order of tie, so that the first one is met last; probes come after them
    down = Window.partitionBy("_key").orderBy(order, "_p", F.desc(tie)).rowsBetween(*_SO_FAR)
    up = Window.partitionBy("_key").orderBy(F.desc(order), "_p", F.desc(tie)).rowsBetween(*_SO_FAR)
    d = F.col(order).cast("double")
    valid = {c: (F.col("_p") == 0) & F.col(c).isNotNull() & F.col(order).isNotNull() for c in curves}
    point = {c: F.when(valid[c], F.struct(d.alias("d"), F.col(c).alias("v"))) for c in curves}
    near = t.withColumns({**{f"_prev_{c}": F.last(point[c], True).over(down) for c in curves},
                          **{f"_next_{c}": F.last(point[c], True).over(up) for c in curves}})
    if single:
        whole = Window.partitionBy("_key")
        spans = {f"_span_{c}": F.struct(F.min(point[c]["d"]).over(whole).alias("lo"), F.max(point[c]["d"]).over(whole).alias("hi")) for c in curves}
        return near.withColumns(spans).where("_p = 1").select(*df.columns, *[f"_{s}_{c}" for s in ("prev", "next", "span") for c in curves])
    near = near.where("_p = 1")
    first = {c: F.min(F.when(valid[c], F.struct(d.alias("d"), F.col(tie).alias("t"), F.col(c).alias("v")))) for c in curves}
    last = {c: F.max(F.when(valid[c], F.struct(d.alias("d"), (-F.col(tie)).alias("t"), F.col(c).alias("v")))) for c in curves}
    summary = t.groupBy("_key").agg(*[first[c].alias(f"_first_{c}") for c in curves], *[last[c].alias(f"_last_{c}") for c in curves])
    summary = summary.withColumns({"_g": F.col("_key.g"), "_b": F.col("_key.b")})
    summary = summary.withColumns({f"_{s}_{c}": F.when(F.col(f"_{s}_{c}").isNotNull(), F.struct(F.col(f"_{s}_{c}.d").alias("d"), F.col(f"_{s}_{c}.v").alias("v")))
                                   for c in curves for s in ("first", "last")})
    whole = Window.partitionBy("_g")
    carry = _carried(summary, curves).withColumns({f"_span_{c}": F.struct(F.min(f"_first_{c}.d").over(whole).alias("lo"), F.max(f"_last_{c}.d").over(whole).alias("hi")) for c in curves})
    carry = carry.select("_key", *[f"_{s}_{c}" for c in curves for s in ("up", "down", "span")])
    j = near.join(carry, "_key")
    out = {**{f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_up_{c}") for c in curves}, **{f"_next_{c}": F.coalesce(f"_next_{c}", f"_down_{c}") for c in curves}}
    return j.withColumns(out).select(*df.columns, *out, *[f"_span_{c}" for c in curves])


__all__ = ["neighbours", "asof_neighbours", "BLOCK_ROWS"]
