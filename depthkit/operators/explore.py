"""Exploratory table jobs on depth series.

All are aggregates, joins with per-group statistics, or bounded-frame windows on the shared
``partitionBy(group).orderBy(depth)`` spec; pairwise curve statistics are one wide aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.quantiles import group_quantiles
from depthkit.operators.blocked import in_blocks, join_null_safe
from depthkit.operators.carry import BLOCK_ROWS, neighbours
from depthkit.session import cut_lineage


def _stack(wide: DataFrame, keys: Sequence[str], names: Sequence[str], cols: dict[str, list[str]]) -> DataFrame:
    """Unpivot a wide one-row-per-key table into (keys, name, col...)."""
    parts = []
    for n in names:
        parts.append(F.struct(F.lit(n).alias("_name"), *[F.col(c.format(n=n)).alias(a) for a, c in cols.items()]))
    return wide.select(*keys, F.explode(F.array(*parts)).alias("_s")).select(*keys, "_s.*")


def well_inventory(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, order: str = S.ORDER) -> DataFrame:
    """Depth range, row count, median step, direction and present-curve list per group."""
    steps = in_blocks(df, lambda w: {"_s": F.col(order) - F.lag(order).over(w)}, 1, group, order)
    agg = steps.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("min_depth"), F.max(order).alias("max_depth"),
        F.concat_ws(",", F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in sorted(curves)]))).alias("curves"),
    )
    med = group_quantiles(steps, [group], "_s", [0.5], ["median_step"])
    return join_null_safe(agg, med, [group], "left").withColumn(
        "direction", F.when(F.col("median_step") > 0, "down").when(F.col("median_step") < 0, "up").otherwise("flat"))


def presence_matrix(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, order: str = S.ORDER, min_span_pct: float = 0.0) -> DataFrame:
    """One row per group with a 0/1 column per curve: 1 if its valid depths span more than ``min_span_pct`` of the
    group's depths (any value at 0)."""
    aggs = [F.min(order).alias("_mn"), F.max(order).alias("_mx")]
    for c in curves:
        aggs += [F.count(c).alias(f"_n_{c}"), (F.max(F.when(F.col(c).isNotNull(), F.col(order))) - F.min(F.when(F.col(c).isNotNull(), F.col(order)))).alias(f"_w_{c}")]
    wide = df.groupBy(group).agg(*aggs)
    enough = lambda c: F.coalesce(F.try_divide(F.col(f"_w_{c}"), F.col("_mx") - F.col("_mn")) * 100 > min_span_pct, F.lit(False)) if min_span_pct > 0 else F.lit(True)
    return wide.select(group, *[((F.col(f"_n_{c}") > 0) & enough(c)).cast("int").alias(c) for c in curves])


def depth_sampling(df: DataFrame, group: str = S.GROUP, order: str = S.ORDER, digits: int = 3, tolerance: float = 0.01, tie: str | None = None,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """D3: (group, n_rows, depth_min, depth_max, step_mode, step_median, n_irregular, direction).

    Steps between neighbours in depth order, rounded to ``digits``; the mode's ties go to the smaller step; a step is
    irregular if it differs from the mode by more than ``tolerance`` of it."""
    d = F.col(order)
    steps = in_blocks(df.select(group, order, *([tie] if tie else [])), lambda w: {"_s": F.round(d - F.lag(d).over(w), digits)}, 1, group, order, tie, block_rows)
    runs = steps.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_k"), F.min(order).alias("_mn"), F.max(order).alias("_mx"))
    mode = F.min(F.when(F.col("_s").isNotNull(), F.struct((-F.col("_k")).alias("k"), F.col("_s").alias("s"))))["s"]
    wells = runs.groupBy(group).agg(F.sum("_k").alias("n_rows"), F.min("_mn").alias("depth_min"), F.max("_mx").alias("depth_max"), mode.alias("step_mode"))
    odd = F.sum(F.when(F.abs(F.col("_s") - F.col("step_mode")) > F.abs(F.col("step_mode")) * tolerance, F.col("_k")).otherwise(0))
    irregular = join_null_safe(runs, wells.select(group, "step_mode"), [group]).groupBy(group).agg(odd.alias("n_irregular"))
    median = group_quantiles(steps, [group], "_s", [0.5], ["step_median"])
    out = join_null_safe(join_null_safe(wells, irregular, [group]), median, [group], "left")
    way = F.when(F.col("step_median") > 0, "increasing").when(F.col("step_median") < 0, "decreasing").otherwise("flat")
    return out.select(group, "n_rows", "depth_min", "depth_max", "step_mode", "step_median", "n_irregular", way.alias("direction"))


def well_metadata(df: DataFrame, curves: Sequence[str], headers: DataFrame | None = None, raw_curves: DataFrame | None = None,
                  group: str = S.GROUP, order: str = S.ORDER) -> DataFrame:
    """One row per well: rows, depth range, curve list, NULL flag and cells, and what the header says.

    ``headers`` has a row per well (its columns are added); ``raw_curves`` (group, curve) lists the
    mnemonics as they were in the file, which become ``curves_original``."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in curves), F.lit(0).cast("long"))
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("depth_min"), F.max(order).alias("depth_max"),
                                F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in sorted(curves)])).alias("_c"), nulls.alias("null_cells"))
    out = out.select(group, "n_rows", "depth_min", "depth_max", F.array_join("_c", ",").alias("curves"), F.size("_c").alias("n_curves"), "null_cells", (F.col("null_cells") > 0).alias("has_nulls"))
    if raw_curves is not None:
        names = raw_curves.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("curve")), ",").alias("curves_original"))
        out = join_null_safe(out, names, [group], "left")
    return join_null_safe(out, headers, [group], "left") if headers is not None else out


def curve_combinations(df: DataFrame, curves: Sequence[str], group: str = S.GROUP) -> DataFrame:
    """Presence matrix per group, then how many groups share each curve combination."""
    pres = df.groupBy(group).agg(*[(F.count(c) > 0).cast("int").alias(c) for c in curves])
    combo = F.concat_ws(",", F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in sorted(curves)])))
    return pres.groupBy(combo.alias("combination")).agg(F.count(F.lit(1)).alias("wells"))


def valid_interval(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, order: str = S.ORDER,
                   min_pct: float = 50.0) -> DataFrame:
    """first/last valid depth per (group, curve), valid share of the depth span, short flag."""
    aggs = [F.min(order).alias("_mn"), F.max(order).alias("_mx")]
    for c in curves:
        aggs += [F.min(F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_f_{c}"),
                 F.max(F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}")]
    wide = df.groupBy(group).agg(*aggs)
    long = _stack(wide, [group, "_mn", "_mx"], curves, {"first_valid": "_f_{n}", "last_valid": "_l_{n}"})
    pct = F.try_divide(F.col("last_valid") - F.col("first_valid"), F.col("_mx") - F.col("_mn")) * 100
    return long.select(group, F.col("_name").alias("curve"), "first_valid", "last_valid", pct.alias("valid_pct"),
                       F.coalesce(pct < min_pct, F.lit(True)).alias("short"))


def curve_distribution(df: DataFrame, curves: Sequence[str]) -> DataFrame:
    """Global distribution per curve (population skewness and excess kurtosis)."""
    aggs = []
    for c in curves:
        aggs += [F.min(c).alias(f"_mn_{c}"), F.max(c).alias(f"_mx_{c}"), F.avg(c).alias(f"_av_{c}"),
                 F.stddev_samp(c).alias(f"_sd_{c}"), F.skewness(c).alias(f"_sk_{c}"), F.kurtosis(c).alias(f"_ku_{c}"),
                 F.count(c).alias(f"_n_{c}")]
    wide = df.agg(*aggs)
    long = _stack(wide, [], curves, {"n": "_n_{n}", "min": "_mn_{n}", "max": "_mx_{n}", "mean": "_av_{n}", "std": "_sd_{n}",
                                     "skew": "_sk_{n}", "kurtosis": "_ku_{n}"}).withColumnRenamed("_name", "curve")
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in curves)
    vals = df.selectExpr(f"stack({len(curves)}, {stack}) as (curve, _v)")
    q = group_quantiles(vals, ["curve"], "_v", [0.01, 0.25, 0.5, 0.75, 0.99], ["p1", "p25", "median", "p75", "p99"])
    return long.join(q, "curve")


def well_boxplot(df: DataFrame, x: str, group: str = S.GROUP) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and flier count per group (NULL and 0 without values)."""
    q = group_quantiles(df, [group], x, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = cut_lineage(q.withColumn("iqr", F.col("q3") - F.col("q1")), "quartiles")  # a row per group, used twice
    j = df.select(group, F.col(x).alias("_x")).filter(F.col("_x").isNotNull())
    j = join_null_safe(j, q, [group])
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    w = j.groupBy(group).agg(F.min(F.when(F.col("_x") >= lo, F.col("_x"))).alias("whisker_lo"),
                             F.max(F.when(F.col("_x") <= hi, F.col("_x"))).alias("whisker_hi"),
                             F.count_if((F.col("_x") < lo) | (F.col("_x") > hi)).alias("n_fliers"))
    return join_null_safe(q, w, [group], "left").withColumn("n_fliers", F.coalesce("n_fliers", F.lit(0).cast("long")))


def gap_runs(df: DataFrame, x: str, group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of consecutive NULLs (gaps-and-islands); one row per run with its extent.

    A run is named by the position of the last valid row before it, so the islands need no
    window of their own, and a run of any length is summed up before it is shuffled."""
    t = neighbours(df, [x], group, order, tie, block_rows).filter(F.col(x).isNull())
    p, n = F.col(f"_prev_{x}"), F.col(f"_next_{x}")
    g = t.groupBy(group, p["i"].alias("_run"), (n["d"] - p["d"]).alias("gap_length")).agg(
        F.min(order).alias("start_depth"), F.max(order).alias("end_depth"), F.count(F.lit(1)).alias("n_rows"))
    return g.select(group, "start_depth", "end_depth", "n_rows", "gap_length")


def gap_summary(runs: DataFrame, group: str = S.GROUP) -> DataFrame:
    return runs.groupBy(group).agg(F.count(F.lit(1)).alias("n_gaps"), F.max("n_rows").alias("max_gap_rows"),
                                   F.sum("n_rows").alias("gap_rows"))


def co_missing(df: DataFrame, curves: Sequence[str]) -> DataFrame:
    """Share of rows where both curves of a pair are NULL, in one aggregate."""
    pairs = list(combinations(curves, 2))
    wide = df.agg(*[(F.avg((F.col(a).isNull() & F.col(b).isNull()).cast("double")) * 100).alias(f"_{a}__{b}") for a, b in pairs])
    arr = F.array(*[F.struct(F.lit(a).alias("curve_a"), F.lit(b).alias("curve_b"), F.col(f"_{a}__{b}").alias("both_null_pct"))
                    for a, b in pairs])
    return wide.select(F.explode(arr).alias("_p")).select("_p.*")


def pair_corr(df: DataFrame, curves: Sequence[str]) -> DataFrame:
    """Pearson correlation, slope and intercept of each curve pair, from one matrix of co-moments."""
    from depthkit.operators.comoment import pair_statistics
    return pair_statistics(df, curves)


def smoothing(df: DataFrame, x: str, window: int = 5, group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None) -> DataFrame:
    """Centered moving average and running median over ``window`` rows."""
    half = window // 2

    def exprs(w):
        fr = w.rowsBetween(-half, window - 1 - half)
        return {f"{x}_ma_{window}": F.avg(x).over(fr), f"{x}_rmed_{window}": F.percentile(F.col(x), F.lit(0.5)).over(fr)}

    return in_blocks(df, exprs, window, group, order, tie)


def autocorrelation(df: DataFrame, x: str, lags: Sequence[int] = (1, 2, 5, 10, 20), group: str = S.GROUP,
                    order: str = S.ORDER, threshold: float = 0.3, tie: str | None = None) -> DataFrame:
    """corr(x, lag(x, k)) within groups for each k; correlation length = first k below threshold."""
    t = in_blocks(df.select(group, order, *([tie] if tie else []), F.col(x).alias("_x")),
                  lambda w: {f"_l{k}": F.lag("_x", k).over(w) for k in lags}, max(lags), group, order, tie)
    wide = t.agg(*[F.corr("_x", f"_l{k}").alias(f"_r{k}") for k in lags])
    arr = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_r{k}").alias("autocorr")) for k in lags])
    out = wide.select(F.explode(arr).alias("_a")).select("_a.*")
    first = out.filter(F.col("autocorr") < threshold).agg(F.min("lag").alias("correlation_length"))
    return out.crossJoin(F.broadcast(first))


def mad_iqr_flags(df: DataFrame, x: str, group: str = S.GROUP, order: str = S.ORDER,
                  mad_k: float = 3.5, iqr_k: float = 1.5, tie: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Two-sided robust flags per row (modified z-score and IQR fences), and whether a
    flagged row is an isolated spike or part of a flagged interval.

    All rows stay: rows without a group are a group, and a group without values has no flags."""
    q = cut_lineage(group_quantiles(df, [group], x, [0.25, 0.5, 0.75], ["_q1", "_med", "_q3"]), "quartiles")  # a row per group
    dev = join_null_safe(df.select(group, F.col(x).alias("_x")), q.select(group, "_med"), [group])
    mad = group_quantiles(dev.select(group, F.abs(F.col("_x") - F.col("_med")).alias("_ad")), [group], "_ad", [0.5], ["_mad"])
    q = cut_lineage(join_null_safe(q, mad, [group], "left"), "quartiles")
    j = join_null_safe(df, q, [group], "left")
    mz = F.try_divide(0.6745 * (F.col(x) - F.col("_med")), F.col("_mad"))
    iqr = F.col("_q3") - F.col("_q1")
    t = j.withColumns({
        "mad_flag": F.coalesce(F.abs(mz) > mad_k, F.lit(False)),
        "iqr_flag": F.coalesce((F.col(x) < F.col("_q1") - iqr_k * iqr) | (F.col(x) > F.col("_q3") + iqr_k * iqr), F.lit(False)),
    })
    flag = F.col("iqr_flag")
    t = t.select(*df.columns, "mad_flag", "iqr_flag")
    t = in_blocks(t, lambda w: {"outlier_kind": F.when(~flag, F.lit(None)).when(
        F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False)), "interval").otherwise("spike")}, 1, group, order, tie, block_rows)
    return t.select(*df.columns, "mad_flag", "iqr_flag", "outlier_kind")


def running_moments(df: DataFrame, x: str, window: int = 20, group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None) -> DataFrame:
    """Trailing mean and sample variance over ``window`` rows (stationarity check)."""
    def exprs(w):
        fr = w.rowsBetween(-(window - 1), 0)
        return {f"{x}_run_mean_{window}": F.avg(x).over(fr), f"{x}_run_var_{window}": F.var_samp(x).over(fr)}

    return in_blocks(df, exprs, window, group, order, tie)


def zscores(df: DataFrame, x: str, group: str = S.GROUP) -> DataFrame:
    """Per-group and global z-scores (sample std); rows without a group are a group."""
    g = df.groupBy(group).agg(F.avg(x).alias("_gm"), F.stddev_samp(x).alias("_gs"))
    a = df.agg(F.avg(x).alias("_am"), F.stddev_samp(x).alias("_as"))
    j = join_null_safe(df, g, [group], "left").crossJoin(F.broadcast(a))
    return j.withColumns({f"{x}_z_well": F.try_divide(F.col(x) - F.col("_gm"), F.col("_gs")),
                          f"{x}_z_global": F.try_divide(F.col(x) - F.col("_am"), F.col("_as"))}).select(
        *df.columns, f"{x}_z_well", f"{x}_z_global")


def target_feasibility(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, min_pct: float = 80.0) -> DataFrame:
    """Per curve, groups with coverage >= min_pct, of all groups."""
    wide = df.groupBy(group).agg(*[(F.count(c) * 100.0 / F.count(F.lit(1))).alias(f"_p_{c}") for c in curves])
    agg = wide.agg(F.count(F.lit(1)).alias("wells_total"), *[F.count_if(F.col(f"_p_{c}") >= min_pct).alias(f"_k_{c}") for c in curves])
    arr = F.array(*[F.struct(F.lit(c).alias("curve"), F.col(f"_k_{c}").alias("wells_ok")) for c in curves])
    return agg.select("wells_total", F.explode(arr).alias("_c")).select("_c.curve", "_c.wells_ok", "wells_total")


def gap_policy(df: DataFrame, x: str, group: str = S.GROUP, order: str = S.ORDER,
               interpolate_below: float = 10.0, exclude_above: float = 100.0, tie: str | None = None,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Interpolate gaps shorter than ``interpolate_below`` (linear in depth) and flag rows
    of gaps longer than ``exclude_above`` as not for training."""
    t = neighbours(df, [x], group, order, tie, block_rows)
    p, n = F.col(f"_prev_{x}"), F.col(f"_next_{x}")
    glen = n["d"] - p["d"]
    interp = F.coalesce(F.try_divide(n["v"] - p["v"], glen), F.lit(0.0)) * (F.col(order) - p["d"]) + p["v"]
    filled = F.when(F.col(x).isNotNull(), F.col(x)).when(glen < interpolate_below, interp)
    dnt = F.col(x).isNull() & (p.isNull() | n.isNull() | (glen > exclude_above))
    return t.withColumns({f"{x}_filled": filled, "do_not_train": dnt}).select(*df.columns, f"{x}_filled", "do_not_train")


def mahalanobis2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mahalanobis distance of (a, b) from the population mean/covariance (closed-form 2x2 inverse)."""
    st = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_pop(a).alias("_vaa"), F.var_pop(b).alias("_vbb"),
        F.covar_pop(a, b).alias("_vab"))
    j = df.crossJoin(F.broadcast(st))
    da, db = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb")
    det = F.col("_vaa") * F.col("_vbb") - F.col("_vab") * F.col("_vab")
    q = F.try_divide(da * da * F.col("_vbb") - 2 * da * db * F.col("_vab") + db * db * F.col("_vaa"), det)
    return j.withColumn("mahalanobis", F.sqrt(q)).select(*df.columns, "mahalanobis")


def neighbor_features(df: DataFrame, x: str, k: int = 3, group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None) -> DataFrame:
    """Values of the k rows above and below (gap-filling regression input)."""
    def exprs(w):
        cols = {}
        for j in range(1, k + 1):
            cols[f"{x}_prev_{j}"] = F.lag(x, j).over(w)
            cols[f"{x}_next_{j}"] = F.lead(x, j).over(w)
        return cols

    return in_blocks(df, exprs, k, group, order, tie)
