"""Feature engineering on depth series.

All window features share one spec ``partitionBy(group).orderBy(order)``; the composer
``engineer_features`` evaluates them in three dependency levels, which Spark plans as one
Exchange and one Sort (the three Window operators reuse the child's distribution and order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import ffill, first_row, flag, full_frame, last_row, safe_div, series_window

# --------------------------------------------------------------------------- expressions


def rolling_frame(w: WindowSpec, window: int) -> WindowSpec:
    """Centered frame of ``window`` rows, the longer half looking back for even sizes."""
    ahead = (window - 1) // 2
    return w.rowsBetween(-(window - 1 - ahead), ahead)


def rolling_exprs(x: str, w: WindowSpec, windows: Sequence[int] = S.ROLLING_WINDOWS,
                  quantiles: bool = True, prefix: str | None = None) -> dict[str, Column]:
    """Centered rolling mean/std/min/max/range/q25/q75, NULL below min_periods."""
    p = prefix or x
    out: dict[str, Column] = {}
    xc = F.col(x)
    for win in windows:
        fr = rolling_frame(w, win)
        ok = F.count(xc).over(fr) >= max(1, win // 3)
        mn = F.min(xc).over(fr)
        mx = F.max(xc).over(fr)
        out[f"{p}_roll_mean_{win}"] = F.when(ok, F.avg(xc).over(fr))
        out[f"{p}_roll_std_{win}"] = F.when(ok, F.stddev_samp(xc).over(fr))
        out[f"{p}_roll_min_{win}"] = F.when(ok, mn)
        out[f"{p}_roll_max_{win}"] = F.when(ok, mx)
        out[f"{p}_roll_range_{win}"] = F.when(ok, mx - mn)
        if quantiles:
            q = F.percentile(xc, F.array(F.lit(0.25), F.lit(0.75))).over(fr)
            out[f"{p}_roll_q25_{win}"] = F.when(ok, q[0])
            out[f"{p}_roll_q75_{win}"] = F.when(ok, q[1])
    return out


def gradient_expr(f: str | Column, w: WindowSpec) -> Column:
    """Unit-spacing gradient, central inside, one-sided at the ends, NULL for 1-row series."""
    fc = F.col(f) if isinstance(f, str) else f
    prev = F.lag(fc, 1).over(w)
    nxt = F.lead(fc, 1).over(w)
    first, last = first_row(w), last_row(w)
    return (
        F.when(first & last, F.lit(None).cast("double"))
        .when(first, nxt - fc)
        .when(last, fc - prev)
        .otherwise((nxt - prev) / 2.0)
    )


def centered_mean3(x: str, w: WindowSpec) -> Column:
    """Centered mean of 3 rows that needs 3 non-null values (W5 smoothing)."""
    fr = w.rowsBetween(-1, 1)
    return F.when(F.count(F.col(x)).over(fr) == 3, F.avg(F.col(x)).over(fr))


def pct_change_expr(f: str, w: WindowSpec, lag: int) -> Column:
    """W8 on a forward-filled column; a zero base gives NULL instead of inf."""
    return safe_div(F.col(f), F.lag(F.col(f), lag).over(w)) - 1


# --------------------------------------------------------------------------- operators



def rolling_features(df: DataFrame, target: str = S.TARGET, windows: Sequence[int] = S.ROLLING_WINDOWS,
                     group: str = S.GROUP, order: str = S.ORDER, quantiles: bool = True, tie: str | None = None,
                     block_rows: int = 1_000_000) -> DataFrame:
    """W1-W3, series cut into blocks."""
    from depthkit.operators.blocked import in_blocks
    return in_blocks(df, lambda w: rolling_exprs(target, w, windows, quantiles), max(windows), group, order, tie, block_rows)


def gradient_features(df: DataFrame, target: str = S.TARGET, lags: Sequence[int] = S.DIFF_LAGS,
                      group: str = S.GROUP, order: str = S.ORDER, tie: str | None = None,
                      block_rows: int = 1_000_000) -> DataFrame:
    """Gradient, smoothed gradient, curvature, differences, percent changes, series cut into blocks."""
    from depthkit.operators.blocked import engineer_features_blocked
    out = engineer_features_blocked(df, target, [], lags, group, order, block_rows=block_rows, tie=tie)
    names = [f"{target}_gradient", f"{target}_gradient_smooth", f"{target}_curvature"]
    for k in lags:
        names += [f"{target}_diff_{k}", f"{target}_pct_change_{k}"]
    return out.select(*df.columns, *names)


def depth_exprs(w: WindowSpec, order: str = S.ORDER,
                depth_window: tuple[float, float] = S.DEPTH_WINDOW) -> dict[str, Column]:
    """W9, W10, P14."""
    d = F.col(order)
    wf = full_frame(w)
    dmin, dmax = F.min(d).over(wf), F.max(d).over(wf)
    pos = (F.row_number().over(w) - 1).cast("long")
    return {
        "depth_normalized": safe_div(d - dmin, dmax - dmin),
        "depth_scaled": d / 1000.0,
        "depth_from_top": d - dmin,
        "depth_from_bottom": dmax - d,
        "sequence_position": pos,
        "sequence_position_norm": pos / F.count(F.lit(1)).over(wf),
        "in_depth_window": flag(d.between(depth_window[0], depth_window[1])),
    }


def depth_features(df: DataFrame, group: str = S.GROUP, order: str = S.ORDER,
                   depth_window: tuple[float, float] = S.DEPTH_WINDOW, tie: str | None = None,
                   block_rows: int = 1_000_000) -> DataFrame:
    """W9, W10, P14 from the position index and the statistics of each series."""
    from depthkit.operators.blocked import position_exprs, series_index
    idx, _ = series_index(df, group, order, block_rows, tie)
    return idx.select(*df.columns, *[v.alias(k) for k, v in position_exprs(order, depth_window).items()])


def gr_intensity_exprs(gr: str = "GR") -> dict[str, Column]:
    """Right-closed bins, fixed categories as 0/1 columns; NULL or outside -> gr_nan."""
    x = F.col(gr)
    e = S.GR_INTENSITY_EDGES
    out: dict[str, Column] = {}
    for i, label in enumerate(S.GR_INTENSITY_LABELS):
        out[f"gr_{label}"] = flag((x > e[i]) & (x <= e[i + 1]))
    out["gr_nan"] = flag(x.isNull() | (x <= e[0]) | (x > e[-1]))
    return out


def lithology_exprs(columns: Sequence[str], thresholds: dict[str, float] = S.LITHOLOGY) -> dict[str, Column]:
    """P7-P11 for the curves present in ``columns``."""
    th = thresholds
    cols = set(columns)
    out: dict[str, Column] = {}
    if "GR" in cols:
        gr = F.col("GR")
        out["is_shale"] = flag(gr >= th["gr_shale_min"])
        out["is_clean_sand"] = flag(gr <= th["gr_sand_max"])
        out["is_mixed_lithology"] = flag((gr > th["gr_sand_max"]) & (gr < th["gr_shale_min"]))
        out.update(gr_intensity_exprs("GR"))
    if "RHOB" in cols:
        out["is_organic_rich"] = flag(F.col("RHOB") <= th["rhob_shale_max"])
    if "NPHI" in cols:
        out["is_clay_organic"] = flag(F.col("NPHI") >= th["nphi_shale_min"])
    if "RT" in cols:
        out["is_resistive"] = flag(F.col("RT") >= th["rt_source_min"])
    present = [c for c in ["GR", "RHOB", "NPHI", "RT"] if c in cols]
    ind = [n for c, n in [("GR", "is_shale"), ("RHOB", "is_organic_rich"), ("RT", "is_resistive")] if c in cols]
    if len(present) >= 2 and ind:
        total = out[ind[0]]
        for n in ind[1:]:
            total = total + out[n]
        out["source_rock_probability"] = total / float(len(ind))
    return out


def lithology_features(df: DataFrame, thresholds: dict[str, float] = S.LITHOLOGY) -> DataFrame:
    return df.withColumns(lithology_exprs(df.columns, thresholds))


def ratio_curves(columns: Sequence[str], curves: Sequence[str] | None = None,
                 max_curves: int | None = None) -> list[str]:
    """Core curves in column order; ``max_curves`` limits their number only where the caller asks for it."""
    if curves is not None:
        return list(curves)
    return [c for c in columns if c in S.CORE_CURVES][:max_curves]


def cross_curve_exprs(columns: Sequence[str], curves: Sequence[str] | None = None,
                      max_features: int | None = None, max_curves: int | None = None) -> dict[str, Column]:
    """P12 pairwise ratios A/(B+eps) of all pairs of core curves, and P13 petrophysical composites.

    The workflow this follows stops at ``schema.MAX_RATIO_CURVES`` curves and
    ``schema.MAX_RATIO_FEATURES`` ratios; pass them to get the same columns."""
    core = ratio_curves(columns, curves, max_curves)
    out: dict[str, Column] = {}
    if len(core) >= 2:
        for i, a in enumerate(core):
            for b in core[i + 1:]:
                if max_features is not None and len(out) >= max_features:
                    break
                out[f"{a}_{b}_ratio"] = safe_div(F.col(a), F.col(b) + S.RATIO_EPS)
    cols = set(columns)
    if {"GR", "RHOB"} <= cols:
        out["gr_rhob_composite"] = safe_div(F.col("GR"), F.col("RHOB"))
    if {"NPHI", "RHOB"} <= cols:
        out["neutron_density_separation"] = F.col("NPHI") - (2.65 - F.col("RHOB")) * 45.0
    if {"GR", "RT"} <= cols:
        out["organic_indicator"] = F.col("GR") * F.log10(F.col("RT") + 1.0)
    return out


def cross_curve_features(df: DataFrame, curves: Sequence[str] | None = None, max_features: int | None = None,
                         max_curves: int | None = None) -> DataFrame:
    return df.withColumns(cross_curve_exprs(df.columns, curves, max_features, max_curves))


def engineer_features(df: DataFrame, target: str = S.TARGET, windows: Sequence[int] = S.ROLLING_WINDOWS,
                      lags: Sequence[int] = S.DIFF_LAGS, group: str = S.GROUP, order: str = S.ORDER,
                      depth_window: tuple[float, float] = S.DEPTH_WINDOW, quantiles: bool = True,
                      ratio_curves_: Sequence[str] | None = None, skew: str = "on",
                      block_rows: int = 1_000_000, tie: str | None = None) -> DataFrame:
    """All per-row features of one target.

    By default series are cut into blocks (``operators.blocked``), so that a task's size does
    not depend on the largest group.  ``skew="off"`` keeps a group in one task, in three window
    levels over one shuffle: the same rows, for callers who know that groups are small.
    ``tie`` orders rows of equal depth."""
    if skew == "on":
        from depthkit.operators.blocked import engineer_features_blocked
        return engineer_features_blocked(df, target, windows, lags, group, order, depth_window, quantiles,
                                         ratio_curves_, block_rows=block_rows, tie=tie)
    w = series_window(group, [order, tie] if tie else order)
    t = target
    base_cols = list(df.columns)
    roll = rolling_exprs(t, w, windows, quantiles)
    lvl_a = {
        **roll,
        "_ff": ffill(t, w),
        "_sm": centered_mean3(t, w),
        **{f"{t}_diff_{k}": F.col(t) - F.lag(F.col(t), k).over(w) for k in lags},
        **depth_exprs(w, order, depth_window),
    }
    lvl_b = {
        f"{t}_gradient": gradient_expr("_ff", w),
        "_smf": ffill("_sm", w),
        **{f"{t}_pct_change_{k}": pct_change_expr("_ff", w, k) for k in lags},
    }
    lvl_c = {
        f"{t}_gradient_smooth": gradient_expr("_smf", w),
        f"{t}_curvature": gradient_expr(f"{t}_gradient", w),
    }
    grad_names = [f"{t}_gradient", f"{t}_gradient_smooth", f"{t}_curvature"]
    for k in lags:
        grad_names += [f"{t}_diff_{k}", f"{t}_pct_change_{k}"]
    depth_names = list(depth_exprs(w, order, depth_window))
    litho = lithology_exprs(base_cols)
    cross = cross_curve_exprs(base_cols, ratio_curves_)
    out = df.withColumns(lvl_a).withColumns(lvl_b).withColumns(lvl_c)
    out = out.select(*base_cols, *roll, *grad_names, *depth_names,
                     *[v.alias(k) for k, v in litho.items()], *[v.alias(k) for k, v in cross.items()])
    return out
