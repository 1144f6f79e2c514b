"""Quality control tables.

Per-group statistics are computed wide (one aggregate with a column per curve, partial
aggregation map-side) and only then unpivoted, so no row is multiplied by the curve count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import numeric_curves, sentinel_to_null
from depthkit.functions.quantiles import group_quantiles
from depthkit.operators.blocked import in_blocks, join_null_safe


def apply_sentinels(df: DataFrame, curves: Sequence[str] | None = None,
                    sentinels: Sequence[float] = S.NULL_SENTINELS) -> DataFrame:
    """Sentinel values -> NULL on every curve."""
    curves = list(curves) if curves is not None else numeric_curves(df)
    return df.withColumns({c: sentinel_to_null(c, sentinels) for c in curves})


def null_report(df: DataFrame, curves: Sequence[str] | None = None, group: str = S.GROUP,
                flag_pct: float = S.HIGH_NULL_FLAG_PCT) -> DataFrame:
    """A1: (group, curve, null_pct, flagged) after sentinels are nulls."""
    curves = list(curves) if curves is not None else numeric_curves(df)
    wide = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_c_{c}") for c in curves]
    )
    stack = ", ".join(f"'{c}', `_c_{c}`" for c in curves)
    long = wide.selectExpr(group, "_n", f"stack({len(curves)}, {stack}) as (curve, _nn)")
    pct = (F.col("_n") - F.col("_nn")) * 100.0 / F.col("_n")
    return long.select(group, "curve", pct.alias("null_pct"), (pct > flag_pct).alias("flagged"))


def completeness(df: DataFrame, curves: Sequence[str] | None = None, group: str | None = S.GROUP) -> DataFrame:
    """Completeness % per (group, curve), or globally per curve when group is None."""
    curves = list(curves) if curves is not None else numeric_curves(df)
    keys = [group] if group else []
    wide = df.groupBy(*keys).agg(*[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(f"_p_{c}") for c in curves])
    stack = ", ".join(f"'{c}', `_p_{c}`" for c in curves)
    return wide.selectExpr(*keys, f"stack({len(curves)}, {stack}) as (curve, completeness_pct)")


def quality_score(df: DataFrame, curves: Sequence[str] | None = None, group: str = S.GROUP) -> DataFrame:
    """A5: max(0, 100 - sum of curve null % / number of columns including depth)."""
    curves = list(curves) if curves is not None else numeric_curves(df)
    n = F.count(F.lit(1))
    pen = None
    for c in curves:
        p = (n - F.count(F.col(c))) * 100.0 / n
        pen = p if pen is None else pen + p
    return df.groupBy(group).agg(F.greatest(F.lit(0.0), 100.0 - pen / float(len(curves) + 1)).alias("quality_score"))


def target_stats(df: DataFrame, target: str = S.TARGET, group: str = S.GROUP,
                 bounds: tuple[float, float] = S.CLIP_RANGES["GR"]) -> DataFrame:
    """A2 + A3: target min/max/mean/sample std/completeness and out-of-range counts."""
    x = F.col(target)
    lo, hi = bounds
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(x).alias("gr_min"),
        F.max(x).alias("gr_max"),
        F.avg(x).alias("gr_mean"),
        F.stddev_samp(x).alias("gr_std"),
        (F.count(x) * 100.0 / F.count(F.lit(1))).alias("gr_completeness"),
        F.count_if(x < lo).alias("below_min"),
        F.count_if(x > hi).alias("above_max"),
    )


def mad_outliers(df: DataFrame, target: str = S.TARGET, group: str = S.GROUP,
                 k: float = S.MAD_THRESHOLD, flag_fraction: float = S.MAD_FLAG_FRACTION) -> DataFrame:
    """A4: high-side MAD outliers: x > median + k * median(|x - median|)."""
    from depthkit.session import cut_lineage
    x = F.col(target)
    vals = cut_lineage(df.select(group, x.alias("_x")).filter(F.col("_x").isNotNull()), "mad-input")
    med = cut_lineage(group_quantiles(vals, [group], "_x", [0.5], ["median"]), "medians")  # a row per group, used three times
    dev = join_null_safe(vals, med, [group]).select(group, F.abs(F.col("_x") - F.col("median")).alias("_d"))
    mad = group_quantiles(dev, [group], "_d", [0.5], ["mad"])
    lim = cut_lineage(join_null_safe(med, mad, [group]).withColumn("limit", F.col("median") + k * F.col("mad")), "limits")
    counts = join_null_safe(vals, lim.select(group, "limit"), [group]).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_valid"), F.count_if(F.col("_x") > F.col("limit")).alias("n_outliers")
    )
    out = join_null_safe(lim, counts, [group])
    return out.select(
        group, "median", "mad", "limit", "n_valid", "n_outliers",
        (F.col("n_outliers") > F.col("n_valid") * flag_fraction).alias("flagged"),
    )


def depth_step_report(df: DataFrame, group: str = S.GROUP, order: str = S.ORDER,
                      file_order: str = S.SRC_ROW) -> DataFrame:
    """Inventory and step statistics in file order."""
    rows = df.select(group, file_order, F.col(order).alias("_d"))
    steps = in_blocks(rows, lambda w: {"_s": F.col("_d") - F.lag("_d").over(w), "_rn": F.col("_idx") + 1}, 1, group, file_order)
    agg = steps.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min_by("_d", file_order).alias("first_depth"),
        F.max_by("_d", file_order).alias("last_depth"),
        F.min("_d").alias("min_depth"),
        F.max("_d").alias("max_depth"),
        F.max(F.when(F.col("_rn") == 2, F.col("_s"))).alias("first_step"),
        F.count_if(F.col("_s") < 0).alias("n_reversals"),
        F.min("_s").alias("min_step"),
        F.max("_s").alias("max_step"),
    )
    med = group_quantiles(steps, [group], "_s", [0.5], ["median_step"])
    out = join_null_safe(agg, med, [group], "left")
    return out.withColumn(
        "direction",
        F.when(F.col("last_depth") > F.col("first_depth"), "increasing")
        .when(F.col("last_depth") < F.col("first_depth"), "decreasing").otherwise("flat"),
    )


def qc_report(df: DataFrame, target: str = S.TARGET, curves: Sequence[str] | None = None,
              group: str = S.GROUP, order: str = S.ORDER, file_order: str = S.SRC_ROW) -> DataFrame:
    """Per-group QC table with a flags array (A1-A5, A10) like the per-file report."""
    curves = list(curves) if curves is not None else numeric_curves(df)
    clean = apply_sentinels(df, curves)
    stats = target_stats(clean, target, group)
    mad = mad_outliers(clean, target, group).select(group, F.col("n_outliers").alias("gr_outliers_mad"), F.col("flagged").alias("_madf"), "n_outliers", "n_valid")
    score = quality_score(clean, curves, group)
    nulls = null_report(clean, curves, group).groupBy(group).agg(
        F.array_sort(F.collect_list(F.when(F.col("flagged"), F.format_string(
            "%s: %.1f%% missing", "curve", F.floor(F.col("null_pct") * 10 + 0.5) / 10)))).alias("_nf")
    )
    steps = depth_step_report(df, group, order, file_order).select(group, "n_reversals")
    out = join_null_safe(stats, mad, [group], "left")
    for part in (score, nulls, steps):
        out = join_null_safe(out, part, [group])
    flags = F.concat(
        F.when(F.col("n_reversals") > 0, F.array(F.format_string("Depth reversals detected: %d", "n_reversals"))).otherwise(F.array()),
        F.col("_nf"),
        F.when(F.col("below_min") > 0, F.array(F.format_string("GR below 10.0: %d values", "below_min"))).otherwise(F.array()),
        F.when(F.col("above_max") > 0, F.array(F.format_string("GR above 250.0: %d values", "above_max"))).otherwise(F.array()),
        F.when(F.col("_madf"), F.array(F.format_string("Statistical outliers: %d values", "n_outliers"))).otherwise(F.array()),
    )
    return out.select(group, "n_rows", "gr_min", "gr_max", "gr_mean", "gr_std", "gr_completeness",
                      "gr_outliers_mad", "quality_score", "n_reversals", flags.alias("flags"))
