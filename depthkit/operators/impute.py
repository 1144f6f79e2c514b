"""Gap filling and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import numeric_curves
from depthkit.functions.quantiles import group_quantiles
from depthkit.operators.blocked import join_null_safe, tiebreak
from depthkit.operators.carry import BLOCK_ROWS, neighbours
from depthkit.operators.ordered import FILL_ROWS, fits_arrow, with_fills
from depthkit.session import cut_lineage


def fill_forward_backward(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, order: str = S.ORDER,
                          suffix: tuple[str, str] = ("_ffill", "_bfill"), tie: str | None = None,
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add forward-filled and backward-filled copies of each curve."""
    near = neighbours(df, curves, group, order, tie, block_rows)
    fills = {}
    for c in curves:
        fills[c + suffix[0]] = F.col(f"_prev_{c}.v")
        fills[c + suffix[1]] = F.col(f"_next_{c}.v")
    return near.select(*df.columns, *[v.alias(k) for k, v in fills.items()])


def interpolated(c: str) -> Column:
    """The curve on a frame from ``carry.neighbours``, gaps filled linearly over the row position; ends take the nearest value."""
    p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
    slope = F.try_divide(n["v"] - p["v"], n["i"] - p["i"])
    between = F.when(p.isNotNull() & n.isNotNull(), slope * (F.col("_idx") - p["i"]) + p["v"])
    return F.coalesce(F.col(c), between, p["v"], n["v"])


def interpolate_index(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, order: str = S.ORDER,
                      tie: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill NULLs by linear interpolation over the row index, both ends by the nearest value."""
    near = neighbours(df, curves, group, order, tie, block_rows)
    return near.select(*[interpolated(c).alias(c) if c in curves else F.col(c) for c in df.columns])


def curve_medians(df: DataFrame, curves: Sequence[str], group: str | None = S.GROUP) -> DataFrame:
    """Exact median per (group, curve) as one wide row per group (``_med_<curve>``)."""
    keys = [group] if group else []
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in curves)
    long = df.selectExpr(*keys, f"stack({len(curves)}, {stack}) as (_curve, _v)").filter(F.col("_v").isNotNull())
    med = group_quantiles(long, keys + ["_curve"], "_v", [0.5], ["_m"])  # a row per (group, curve) that has a row in long
    return med.groupBy(*keys).agg(*[F.max(F.when(F.col("_curve") == c, F.col("_m"))).alias(f"_med_{c}") for c in curves])


def _null_mask(curves: Sequence[str]):
    """The row's null curves as bits."""
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(curves)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def imputation_plan(df: DataFrame, curves: Sequence[str], group: str = S.GROUP, threshold: float = S.IMPUTATION_THRESHOLD,
                    interp_below: float = S.INTERPOLATE_BELOW_PCT, min_usable_rows: int = S.MIN_USABLE_ROWS) -> DataFrame:
    """One row per group: the missing share of each curve (``_pct_<c>``) and which rows stay NULL.

    All that the policy needs to know about a group is how many rows have each pattern of NULL
    curves, so the rows are aggregated once, by (group, pattern).  Curves are then processed in
    order on that table, as the policy does on the rows: a neighbour curve is available if more than half of its
    rows have a value *by then*, and a row can be filled from neighbours if the curve or an
    available neighbour has a value in it *by then*.  ``_stay`` maps patterns to the bits of
    the curves that stay NULL (only patterns that have any)."""
    t = df.groupBy(group, _null_mask(curves).alias("_mask")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(group)
    t = t.withColumn("_rows", F.sum("_k").over(w))
    null = [F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(curves))]
    now = list(null)  # whether a pattern's rows are NULL in each curve, as processing goes on
    count = lambda cond: F.sum(F.when(cond, F.col("_k")).otherwise(0)).over(w)
    t = t.withColumns({f"_miss_{i}": count(null[i]) for i in range(len(curves))})
    for i in range(len(curves)):
        others = [j for j in range(len(curves)) if j != i]
        t = t.withColumns({f"_av_{i}_{j}": count(~now[j]) > F.col("_rows") * 0.5 for j in others})
        any_av, usable = F.lit(False), ~now[i]
        for j in others:
            any_av = any_av | F.col(f"_av_{i}_{j}")
            usable = usable | (F.col(f"_av_{i}_{j}") & ~now[j])
        t = t.withColumns({f"_use_{i}": usable, f"_any_{i}": any_av})
        t = t.withColumn(f"_nuse_{i}", count(F.col(f"_use_{i}")))
        pct = F.col(f"_miss_{i}") * 100.0 / F.col("_rows")
        between = (pct >= interp_below) & (pct < threshold) & F.col(f"_any_{i}") & (F.col(f"_nuse_{i}") > min_usable_rows)
        t = t.withColumn(f"_null_{i}", null[i] & ((between & ~F.col(f"_use_{i}")) | (F.col(f"_miss_{i}") == F.col("_rows"))))
        now[i] = F.col(f"_null_{i}")
    stay = F.lit(0).cast("long")
    for i in range(len(curves)):
        stay = stay + F.when(F.col(f"_null_{i}"), F.lit(1 << i)).otherwise(0).cast("long")
    t = t.withColumn("_bits", stay)
    return t.groupBy(group).agg(
        *[F.first(F.col(f"_miss_{i}") * 100.0 / F.col("_rows")).alias(f"_pct_{c}") for i, c in enumerate(curves)],
        F.map_from_entries(F.collect_list(F.when(F.col("_bits") != 0, F.struct("_mask", "_bits")))).alias("_stay"))


def impute_policy(df: DataFrame, curves: Sequence[str] | None = None, group: str = S.GROUP, order: str = S.ORDER,
                  threshold: float = S.IMPUTATION_THRESHOLD, interp_below: float = S.INTERPOLATE_BELOW_PCT,
                  with_flags: bool = False, materialize: bool = True, min_usable_rows: int = S.MIN_USABLE_ROWS,
                  block_rows: int = BLOCK_ROWS):
    """Per (group, curve) choose the fill by the curve's missing percentage.

    0 % -> unchanged; < ``interp_below`` -> W11; < ``threshold`` -> neighbour-curve branch;
    otherwise median fill plus a ``high_missing`` flag (A9).  In the neighbour-curve branch
    the workflow fills medians before its KNN step, so the effective result is the median,
    except rows in which the curve and all available neighbours are NULL: they stay NULL if
    more than ``min_usable_rows`` rows are usable (see ``imputation_plan``).  A curve without
    any value stays NULL."""
    curves = list(curves) if curves is not None else numeric_curves(df)
    if materialize:
        df = cut_lineage(df, "impute-input")  # read by the plan, the medians and the fill
    plan = imputation_plan(df, curves, group, threshold, interp_below, min_usable_rows)
    stats = plan.join(curve_medians(df, curves, group), group, "left")
    if materialize:
        stats = cut_lineage(stats, "impute-plan")  # one row per group
    rows = df.withColumn("_mask", _null_mask(curves)).join(stats, group, "left")  # rows without a group stay as they are
    # only curves that some group interpolates need the neighbours of a gap
    small = stats.agg(*[F.max((F.col(f"_pct_{c}") > 0) & (F.col(f"_pct_{c}") < interp_below)).alias(c) for c in curves]).first()
    gaps = [c for c in curves if small[c]]
    if gaps:
        rows = neighbours(rows, gaps, group, order, block_rows=block_rows)
    interp = {c: interpolated(c) for c in gaps}
    kept = F.coalesce(F.element_at("_stay", F.col("_mask")), F.lit(0).cast("long"))
    out = {}
    for i, c in enumerate(curves):
        p, med = F.col(f"_pct_{c}"), F.coalesce(F.col(c), F.col(f"_med_{c}"))
        filled = F.when(kept.bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).otherwise(med)
        out[c] = F.when(p < interp_below, interp[c]).otherwise(filled) if c in gaps else filled
    res = rows.withColumns(out).select(*df.columns)
    if not with_flags:
        return res
    return res, missing_flags(stats, curves, group, threshold)


def missing_flags(stats: DataFrame, curves: Sequence[str], group: str, threshold: float) -> DataFrame:
    """(group, curve, issue, percentage) of the curves at or above the threshold."""
    flags = stats.select(group, F.explode(F.array(*[
        F.struct(F.lit(c).alias("curve"), F.col(f"_pct_{c}").alias("percentage")) for c in curves])).alias("_f"))
    return flags.filter(F.col("_f.percentage") >= threshold).select(
        group, F.col("_f.curve").alias("curve"), F.lit("high_missing").alias("issue"), F.col("_f.percentage").alias("percentage"))


def impute_median(df: DataFrame, curves: Sequence[str], group: str | None = S.GROUP) -> DataFrame:
    """Median fill per group (or globally when ``group`` is None).

    Rows without a group are a group; a curve without any value in a group stays NULL there."""
    df = cut_lineage(df, "median-input")  # read by the medians and the fill
    meds = curve_medians(df, curves, group)
    j = join_null_safe(df, meds, [group], "left") if group else df.crossJoin(F.broadcast(meds))
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in curves}).select(*df.columns)


def _largest(df: DataFrame, group: str) -> int:
    """Rows of the largest series."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def _filled(df: DataFrame, curves: dict[str, bool], group: str, order: str) -> DataFrame:
    """``df`` with gaps of curves filled inside each series (see ``ordered.with_fills``), series whole in a task, rows in the
    order of ``carry.neighbours``."""
    t = df.withColumns({"_tb": tiebreak(df), "_key": F.struct(F.col(group).alias("g"))})
    t = t.withColumns({c: F.col(c).cast("double") for c in curves})
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(order, "_tb")))
    t = t.sortWithinPartitions("_key", order, "_tb").withColumn("_r", F.col("_r").cast("long") - 1)
    return with_fills(t.select(*df.columns, "_r"), curves, "_r")


def impute_by_family(df: DataFrame, features: Sequence[str], group: str = S.GROUP, order: str = S.ORDER,
                     family=None, materialize: bool = True, block_rows: int = BLOCK_ROWS, fit_on: Column | None = None) -> DataFrame:
    """Fill feature NULLs by family, within each group in depth order.

    rolling -> forward fill, backward fill, then the global median;
    gradient -> interpolation over the row index (ends nearest), then 0;
    ratio -> interpolation, then the global median; base -> the global median.
    Global medians are exact and computed in one distributed pass over a long view, over the rows where
    ``fit_on`` holds (the training rows) if it is given.
    """
    from depthkit.operators.evaluate import feature_family

    family = family or feature_family
    feats = list(features)
    if materialize:
        df = cut_lineage(df, "family-input")  # read by the count, median and fill passes
    # one cheap pass: only columns that contain NULLs need a fill (and a median)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in feats]).first().asDict()
    todo = [c for c in feats if nulls[c] > 0]
    need_med = [c for c in todo if family(c) != "gradient"]
    ordered = [c for c in todo if family(c) in ("rolling", "gradient", "ratio")]
    filled = bool(ordered) and fits_arrow(df) and _largest(df, group) <= min(block_rows, FILL_ROWS)
    if filled:
        t = _filled(df, {c: family(c) != "rolling" for c in ordered}, group, order)
    else:
        t = neighbours(df, ordered, group, order, block_rows=block_rows) if ordered else df
    if need_med:
        t = t.crossJoin(F.broadcast(curve_medians(df if fit_on is None else df.filter(fit_on), need_med, None)))
    out = {}
    for c in todo:
        fam = family(c)
        med = F.col(f"_med_{c}")
        if filled and c in ordered:
            out[c] = F.coalesce(F.col(c), F.lit(0.0) if fam == "gradient" else med)
        elif fam == "rolling":
            out[c] = F.coalesce(F.col(f"_prev_{c}.v"), F.col(f"_next_{c}.v"), med)
        elif fam == "gradient":
            out[c] = F.coalesce(interpolated(c), F.lit(0.0))
        elif fam == "ratio":
            out[c] = F.coalesce(interpolated(c), med)
        else:
            out[c] = F.coalesce(F.col(c), med)
    return t.withColumns(out).select(*df.columns) if out else df
