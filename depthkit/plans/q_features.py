"""Registered feature queries (W1-W10, P7-P14) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.operators import features as FE
from depthkit.operators.clean import clip_ranges
from depthkit.plans.common import E, L, R, register, round_doubles, sql

W = "PARTITION BY well_api ORDER BY DEPTH"


def _roll_sql(x: str, win: int) -> dict[str, str]:
    ahead = (win - 1) // 2
    back = win - 1 - ahead
    fr = f"OVER ({W} ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    ok = f"count({x}) {fr} >= {max(1, win // 3)}"
    return {
        f"{x}_roll_mean_{win}": f"CASE WHEN {ok} THEN avg({x}) {fr} END",
        f"{x}_roll_std_{win}": f"CASE WHEN {ok} THEN stddev_samp({x}) {fr} END",
        f"{x}_roll_min_{win}": f"CASE WHEN {ok} THEN min({x}) {fr} END",
        f"{x}_roll_max_{win}": f"CASE WHEN {ok} THEN max({x}) {fr} END",
        f"{x}_roll_range_{win}": f"CASE WHEN {ok} THEN max({x}) {fr} - min({x}) {fr} END",
        f"{x}_roll_q25_{win}": f"CASE WHEN {ok} THEN quantile_cont({x}, 0.25) {fr} END",
        f"{x}_roll_q75_{win}": f"CASE WHEN {ok} THEN quantile_cont({x}, 0.75) {fr} END",
    }


def _rolling_query(win: int):
    def q(spark, sf):
        df = E(spark, sf).select("well_api", "DEPTH", "GR")
        return round_doubles(FE.rolling_features(df, "GR", [win]))

    cols = _roll_sql("GR", win)
    body = "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR, " + ", ".join(
        f"{R(v)} AS {k}" for k, v in cols.items()) + " FROM e"
    register(f"rolling_{win}", sql(body))(q)


for _w in S.ROLLING_WINDOWS:
    _rolling_query(_w)


def _grad_case(f: str) -> str:
    return (f"CASE WHEN n = 1 THEN NULL WHEN rn = 1 THEN lead({f}) OVER ({W}) - {f} "
            f"WHEN rn = n THEN {f} - lag({f}) OVER ({W}) "
            f"ELSE (lead({f}) OVER ({W}) - lag({f}) OVER ({W})) / 2 END")


GRADIENT_SQL_LEVELS = f"""
g1 AS (SELECT *,
         last_value(GR IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff,
         CASE WHEN count(GR) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3
              THEN avg(GR) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS sm,
         row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY well_api) AS n
       FROM src),
g2 AS (SELECT *, {_grad_case('ff')} AS GR_gradient,
         last_value(sm IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS smf
       FROM g1),
g3 AS (SELECT *, {_grad_case('smf')} AS GR_gradient_smooth, {_grad_case('GR_gradient')} AS GR_curvature,
         GR - lag(GR, 1) OVER ({W}) AS GR_diff_1, GR - lag(GR, 3) OVER ({W}) AS GR_diff_3,
         GR - lag(GR, 5) OVER ({W}) AS GR_diff_5,
         ff / nullif(lag(ff, 1) OVER ({W}), 0) - 1 AS GR_pct_change_1,
         ff / nullif(lag(ff, 3) OVER ({W}), 0) - 1 AS GR_pct_change_3,
         ff / nullif(lag(ff, 5) OVER ({W}), 0) - 1 AS GR_pct_change_5
       FROM g2)
"""
GRADIENT_COLS = ["GR_gradient", "GR_gradient_smooth", "GR_curvature", "GR_diff_1", "GR_pct_change_1",
                 "GR_diff_3", "GR_pct_change_3", "GR_diff_5", "GR_pct_change_5"]


@register("gradients", sql(", src AS (SELECT well_api, DEPTH, GR FROM e), " + GRADIENT_SQL_LEVELS +
                           "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR, " +
                           ", ".join(f"{R(c)} AS {c}" for c in GRADIENT_COLS) + " FROM g3"))
def gradients(spark, sf):
    df = E(spark, sf).select("well_api", "DEPTH", "GR")
    return round_doubles(FE.gradient_features(df, "GR"))


DEPTH_SQL = {
    "depth_normalized": "(DEPTH - min(DEPTH) OVER p) / nullif(max(DEPTH) OVER p - min(DEPTH) OVER p, 0)",
    "depth_scaled": "DEPTH / 1000",
    "depth_from_top": "DEPTH - min(DEPTH) OVER p",
    "depth_from_bottom": "max(DEPTH) OVER p - DEPTH",
    "sequence_position": f"CAST(row_number() OVER ({W}) - 1 AS BIGINT)",
    "sequence_position_norm": f"(row_number() OVER ({W}) - 1) / count(*) OVER p",
    "in_depth_window": "CAST(DEPTH >= 4000 AND DEPTH <= 12000 AS INTEGER)",
}


def _depth_select() -> str:
    parts = []
    for k, v in DEPTH_SQL.items():
        parts.append(f"{v} AS {k}" if k in ("sequence_position", "in_depth_window") else f"{R(v)} AS {k}")
    return ", ".join(parts)


@register("depth_position", sql("SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + _depth_select() +
                                " FROM e WINDOW p AS (PARTITION BY well_api)"))
def depth_position(spark, sf):
    df = E(spark, sf).select("well_api", "DEPTH")
    return round_doubles(FE.depth_features(df))


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


LITHO_SQL = {
    "is_shale": _flag("GR >= 80"),
    "is_clean_sand": _flag("GR <= 50"),
    "is_mixed_lithology": _flag("GR > 50 AND GR < 80"),
    "gr_very_low": _flag("GR > 0 AND GR <= 30"),
    "gr_low": _flag("GR > 30 AND GR <= 50"),
    "gr_medium": _flag("GR > 50 AND GR <= 80"),
    "gr_high": _flag("GR > 80 AND GR <= 150"),
    "gr_very_high": _flag("GR > 150 AND GR <= 300"),
    "gr_nan": _flag("GR IS NULL OR GR <= 0 OR GR > 300"),
    "is_organic_rich": _flag("RHOB <= 2.4"),
    "is_clay_organic": _flag("NPHI >= 20"),
    "is_resistive": _flag("RT >= 10"),
}
LITHO_PROB_SQL = "(" + " + ".join([LITHO_SQL["is_shale"], LITHO_SQL["is_organic_rich"], LITHO_SQL["is_resistive"]]) + ") / 3.0"


@register("lithology_flags", sql("SELECT well_api, " + R("DEPTH") + " AS DEPTH, " +
                                 ", ".join(f"{v} AS {k}" for k, v in LITHO_SQL.items()) +
                                 f", {R(LITHO_PROB_SQL)} AS source_rock_probability FROM l"))
def lithology_flags(spark, sf):
    df = L(spark, sf)
    out = FE.lithology_features(df)
    return round_doubles(out.drop("operator_id", "GR", "RHOB", "NPHI", "RT", "PE"))


def _ratio_sql() -> dict[str, str]:
    core = ["GR", "RHOB", "NPHI", "RT", "PE"]
    out = {}
    for i, a in enumerate(core):
        for b in core[i + 1:]:
            out[f"{a}_{b}_ratio"] = f"{a} / nullif({b} + 1e-8, 0)"
    out["gr_rhob_composite"] = "GR / nullif(RHOB, 0)"
    out["neutron_density_separation"] = "NPHI - (2.65 - RHOB) * 45"
    out["organic_indicator"] = "GR * CASE WHEN RT + 1 > 0 THEN log10(RT + 1) END"
    return out


@register("curve_ratios", sql("SELECT well_api, " + R("DEPTH") + " AS DEPTH, " +
                              ", ".join(f"{R(v)} AS {k}" for k, v in _ratio_sql().items()) + " FROM l"))
def curve_ratios(spark, sf):
    df = L(spark, sf)
    out = FE.cross_curve_features(df)
    return round_doubles(out.drop("operator_id", "GR", "RHOB", "NPHI", "RT", "PE"))


def well_features_df(spark, sf):
    """Flagship: events log -> sentinels -> clip -> every per-row feature of GR."""
    df = clip_ranges(E(spark, sf).select("well_api", "DEPTH", "GR"))
    return round_doubles(FE.engineer_features(df, "GR"))


def _well_features_sql() -> str:
    roll = {}
    for w in S.ROLLING_WINDOWS:
        roll.update(_roll_sql("GR", w))
    litho = {k: v for k, v in LITHO_SQL.items() if k in (
        "is_shale", "is_clean_sand", "is_mixed_lithology", "gr_very_low", "gr_low", "gr_medium", "gr_high",
        "gr_very_high", "gr_nan")}
    body = (", src AS (SELECT well_api, DEPTH, CASE WHEN GR IS NULL THEN NULL ELSE least(greatest(GR, 10.0), 250.0) END AS GR FROM e), "
            + GRADIENT_SQL_LEVELS +
            "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR, "
            + ", ".join(f"{R(v)} AS {k}" for k, v in roll.items()) + ", "
            + ", ".join(f"{R(c)} AS {c}" for c in GRADIENT_COLS) + ", "
            + _depth_select() + ", "
            + ", ".join(f"{v} AS {k}" for k, v in litho.items())
            + " FROM g3 WINDOW p AS (PARTITION BY well_api)")
    return sql(body)


register("well_features", _well_features_sql())(well_features_df)


def well_features_blocked_df(spark, sf):
    """Flagship on the hot-group plan: bounded (well, block) tasks, same result."""
    df = clip_ranges(E(spark, sf).select("well_api", "DEPTH", "GR"))
    return round_doubles(FE.engineer_features(df, "GR", skew="on", block_rows=32))


register("well_features_blocked", _well_features_sql())(well_features_blocked_df)


#: A third of all wells are one, some wells and depths are NULL, and depths tie (``src_row`` orders them).
HOT_SQL = (", hot AS (SELECT CASE WHEN src_row % 41 = 0 THEN NULL WHEN well_api % 3 = 0 THEN 0 ELSE well_api END AS well_api, src_row, "
           "CASE WHEN src_row % 37 = 0 THEN NULL ELSE floor(DEPTH) END AS DEPTH, GR FROM e)")


def _hot_features_sql() -> str:
    body = _well_features_sql().replace(W, W + " NULLS FIRST, src_row")
    body = body.replace(", src AS (SELECT well_api, DEPTH, ", HOT_SQL + ", src AS (SELECT well_api, src_row, DEPTH, ").replace("AS GR FROM e), ", "AS GR FROM hot), ")
    body = body.replace(DEPTH_SQL["in_depth_window"], f"coalesce({DEPTH_SQL['in_depth_window']}, 0)")
    return body.replace("SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR"), "SELECT well_api, src_row, " + R("DEPTH") + " AS DEPTH, " + R("GR"))


def hot_well_df(spark, sf):
    e = E(spark, sf)
    well = F.when(F.col("src_row") % 41 == 0, F.lit(None)).when(F.col("well_api") % 3 == 0, F.lit(0)).otherwise(F.col("well_api"))
    depth = F.when(F.col("src_row") % 37 == 0, F.lit(None)).otherwise(F.floor("DEPTH").cast("double"))
    return e.select(well.cast("long").alias("well_api"), "src_row", depth.alias("DEPTH"), "GR")


@register("well_features_hot", _hot_features_sql())
def well_features_hot(spark, sf):
    """One hot well, null wells, null depths and tied depths through the block plan."""
    return round_doubles(FE.engineer_features(clip_ranges(hot_well_df(spark, sf)), "GR", block_rows=64, tie="src_row"))
