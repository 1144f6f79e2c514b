"""Registered queries: co-moments and the filters on them, mutual information, drift, stratified splits, formations, nearest donors."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.operators import comoment as CO
from depthkit.operators import formations as FO
from depthkit.operators import knn as KN
from depthkit.operators import selection as SE
from depthkit.operators import split as SP
from depthkit.operators.features import engineer_features
from depthkit.plans.common import E, L, L_CURVES, ORACLES, R, register, round_doubles, sql
from depthkit.plans.q_mlprep import MD5, SPLIT_CTE
from depthkit.session import cut_lineage

# ------------------------------------------------------------------ variance and correlation filter

#: The events log's features: 21 rolling, 9 gradient, 7 depth and 9 lithology columns.
FILTER_FEATURES = ([f"GR_roll_{k}_{w}" for w in S.ROLLING_WINDOWS for k in ("mean", "std", "min", "max", "range", "q25", "q75")]
                   + ["GR_gradient", "GR_gradient_smooth", "GR_curvature", *[f"GR_{k}_{j}" for j in S.DIFF_LAGS for k in ("diff", "pct_change")]]
                   + ["depth_normalized", "depth_scaled", "depth_from_top", "depth_from_bottom", "sequence_position", "sequence_position_norm", "in_depth_window"]
                   + ["is_shale", "is_clean_sand", "is_mixed_lithology", "gr_very_low", "gr_low", "gr_medium", "gr_high", "gr_very_high", "gr_nan"])
MAX_CORR, MIN_VARIANCE = 0.98, 0.001


def event_features(spark, sf):
    from depthkit.operators.clean import clip_ranges
    return cut_lineage(engineer_features(clip_ranges(E(spark, sf).select("well_api", "DEPTH", "GR")), "GR"), "features")


def _filter_sql() -> str:
    """The features by the flagship's SQL; all pairs; then the greedy choice by recursion."""
    f = FILTER_FEATURES
    source = ORACLES["well_features"]
    pairs = " UNION ALL ".join(f"SELECT {j} AS j, list_filter([" + ", ".join(f"CASE WHEN isfinite(corr({f[i]}, {f[j]})) AND abs(corr({f[i]}, {f[j]})) > {MAX_CORR} THEN {i} END" for i in range(j))
                               + f"], lambda x: x IS NOT NULL)::INT[] AS near, var_pop({f[j]}) AS variance, '{f[j]}' AS feature FROM ff" for j in range(len(f)))
    return f"""WITH RECURSIVE ff AS MATERIALIZED ({source}),
p AS MATERIALIZED ({pairs}),
g(j, kept) AS (
  SELECT -1, []::INT[]
  UNION ALL
  SELECT p.j, CASE WHEN variance > {MIN_VARIANCE} AND NOT list_has_any(near, kept) THEN list_append(kept, p.j) ELSE kept END
  FROM g JOIN p ON p.j = g.j + 1
)
SELECT p.feature, {R('p.variance')} AS variance, list_contains(g.kept, p.j) AS kept,
  CASE WHEN list_contains(g.kept, p.j) THEN NULL WHEN variance <= {MIN_VARIANCE} THEN 'variance'
       ELSE (SELECT q.feature FROM p q WHERE q.j = list_min(list_intersect(p.near, g.kept))) END AS reason
FROM p JOIN g USING (j)"""


@register("correlation_filter", _filter_sql())
def correlation_filter(spark, sf):
    """The features are rounded as the flagship's oracle rounds them, so that both engines see the same values."""
    return round_doubles(CO.select_uncorrelated(round_doubles(event_features(spark, sf)), FILTER_FEATURES, MIN_VARIANCE, MAX_CORR))


# ------------------------------------------------------------------------------ mutual information


def _mi_sql(target: str, features: list[str], bins: int = 10) -> str:
    qs = [i / bins for i in range(1, bins)]
    cut = lambda c: " + ".join(f"({c} > e_{c}[{i + 1}])::INT" for i in range(len(qs)))
    edges = ", ".join(f"quantile_cont({c}, {qs}) AS e_{c}" for c in [*features, target])
    parts = []
    for c in features:
        parts.append(f"""SELECT '{c}' AS feature, any_value(n) AS n, sum(k / n * ln(k * n / (nx * ny))) AS mi FROM (
  SELECT k::DOUBLE AS k, sum(k) OVER ()::DOUBLE AS n, sum(k) OVER (PARTITION BY x)::DOUBLE AS nx, sum(k) OVER (PARTITION BY y)::DOUBLE AS ny
  FROM (SELECT {cut(c)} AS x, {cut(target)} AS y, count(*) AS k FROM l CROSS JOIN ed WHERE {c} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1, 2))""")
    return sql(f", ed AS (SELECT {edges} FROM l), m AS (" + " UNION ALL ".join(parts) + f") SELECT feature, CAST(n AS BIGINT) AS n, {R('mi')} AS mi, "
               "CAST(row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS INTEGER) AS rank FROM m")


@register("mutual_information", _mi_sql("GR", ["RHOB", "NPHI", "RT", "PE"]))
def mutual_information(spark, sf):
    return round_doubles(SE.mutual_information(L(spark, sf).drop("operator_id"), ["RHOB", "NPHI", "RT", "PE"], "GR"))


# ------------------------------------------------------------------------------------------- drift


def _drift_sql(bins: int = 10) -> str:
    qs = [i / bins for i in range(1, bins)]
    parts = []
    for c in L_CURVES:
        bin_ = " + ".join(f"(x > e[{i + 1}])::INT" for i in range(len(qs)))
        parts.append(f"""SELECT '{c}' AS curve, o.part, o.n, r.n AS n_reference,
  (SELECT max(abs(fa - fb)) FROM (SELECT sum(a) OVER w / o.n AS fa, sum(b) OVER w / r.n AS fb FROM (
     SELECT {c} AS x, count(*) FILTER (WHERE split = o.part) AS a, count(*) FILTER (WHERE split = 'train') AS b FROM j WHERE {c} IS NOT NULL AND split IN (o.part, 'train') GROUP BY 1) WINDOW w AS (ORDER BY x))) AS ks,
  (SELECT sum((p - q) * ln(p / q)) FROM (
     SELECT greatest(coalesce(a, 0) / o.n, 1e-6) AS p, greatest(coalesce(b, 0) / r.n, 1e-6) AS q FROM (SELECT unnest(range(0, {bins})) AS bin) all_bins LEFT JOIN (
       SELECT {bin_} AS bin, count(*) FILTER (WHERE split = o.part) AS a, count(*) FILTER (WHERE split = 'train') AS b
       FROM (SELECT {c} AS x, split FROM j WHERE {c} IS NOT NULL AND split IN (o.part, 'train')), (SELECT quantile_cont({c}, {qs}) AS e FROM j WHERE split = 'train') GROUP BY 1) USING (bin))) AS psi
FROM (SELECT split AS part, count({c}) AS n FROM j WHERE split <> 'train' GROUP BY 1) o, (SELECT count({c}) AS n FROM j WHERE split = 'train') r""")
    return sql(SPLIT_CTE + ", j AS MATERIALIZED (SELECT l.*, split FROM l JOIN sp USING (well_api)), dr AS (" + " UNION ALL ".join(parts)
               + f") SELECT curve, part, n, n_reference, {R('ks')} AS ks, {R('psi')} AS psi FROM dr")


@register("split_drift", _drift_sql())
def split_drift(spark, sf):
    df = L(spark, sf).drop("operator_id")
    return round_doubles(SE.drift(SP.assign_split(df, SP.split_wells(df, 0.6, 0.2)), L_CURVES, "split", "train"))


# -------------------------------------------------------------------------------- stratified split


@register("split_apportioned", sql(f""",
wl AS (SELECT well_api, min(operator_id) AS operator_id FROM l GROUP BY well_api),
o AS (SELECT *, row_number() OVER (PARTITION BY operator_id ORDER BY {MD5}, well_api) - 1 AS r, count(*) OVER (PARTITION BY operator_id) AS n FROM wl),
m AS (SELECT *, least(3, n // 3) AS m FROM o),
w AS (SELECT *, n - 3 * m AS rest, greatest(n * 0.6::DOUBLE - m, 0) AS w1, greatest(n * 0.2::DOUBLE - m, 0) AS w2 FROM m),
q AS (SELECT *, coalesce(rest * w1 / nullif(w1 + w2 + w2, 0), 0) + 1e-9 AS q1, coalesce(rest * w2 / nullif(w1 + w2 + w2, 0), 0) + 1e-9 AS q2 FROM w),
f AS (SELECT *, rest - floor(q1) - 2 * floor(q2) AS over, floor((q1 - floor(q1)) * 1e6) AS p1, floor((q2 - floor(q2)) * 1e6) AS p2 FROM q),
s AS (SELECT *, m + floor(q1) + ((2 * (p2 > p1)::INT) < over)::INT AS train, m + floor(q2) + (((p1 >= p2)::INT + 1) < over)::INT AS val FROM f)
SELECT well_api, operator_id, CASE WHEN r < train THEN 'train' WHEN r < train + val THEN 'validation' ELSE 'test' END AS split FROM s"""))
def split_apportioned(spark, sf):
    return SP.split_apportioned(L(spark, sf), operator="operator_id")


# -------------------------------------------------------------------------------------- formations

#: Tops of each well as shares of its depth range: an open top, an overlap, an open base, an empty interval.
TOPS = [("upper", None, 0.35), ("middle", 0.25, 0.6), ("lower", 0.7, None), ("empty", 0.5, 0.5)]


def tops(df):
    span = df.groupBy("well_api").agg(F.min("DEPTH").alias("mn"), (F.max("DEPTH") - F.min("DEPTH")).alias("w"))
    at = lambda x: F.lit(None).cast("double") if x is None else F.floor(F.col("mn") + x * F.col("w")).cast("double")
    return span.select("well_api", F.explode(F.array(*[F.struct(F.lit(n).alias("formation"), at(a).alias("top"), at(b).alias("base")) for n, a, b in TOPS])).alias("t")).select("well_api", "t.*")


_AT = lambda x: "NULL::DOUBLE" if x is None else f"floor(mn + {x} * w)"
TOPS_SQL = (", span AS (SELECT well_api, min(DEPTH) AS mn, max(DEPTH) - min(DEPTH) AS w FROM l GROUP BY well_api), tops AS ("
            + " UNION ALL ".join(f"SELECT well_api, '{n}' AS formation, {_AT(a)} AS top, {_AT(b)} AS base FROM span" for n, a, b in TOPS)
            + "), jf AS (SELECT l.*, formation FROM l LEFT JOIN tops t ON l.well_api = t.well_api AND (top IS NULL OR DEPTH >= top) AND (base IS NULL OR DEPTH < base))")


@register("formation_scaled", sql(TOPS_SQL + ", st AS (SELECT well_api, formation, avg(GR) AS m, stddev_samp(GR) AS s FROM jf GROUP BY ALL) SELECT jf.well_api, " + R("DEPTH")
                                  + " AS DEPTH, jf.formation, " + R("GR") + " AS GR, " + R("(GR - m) / nullif(s, 0)") + " AS GR_z_formation FROM jf JOIN st ON jf.well_api = st.well_api "
                                  "AND jf.formation IS NOT DISTINCT FROM st.formation"))
def formation_scaled(spark, sf):
    df = L(spark, sf).select("well_api", "DEPTH", "GR")
    joined = FO.in_formations(df, tops(df), bucket=50.0).select("well_api", "DEPTH", "formation", "GR")
    return round_doubles(FO.formation_scaled(joined, "GR"))


@register("formation_moments", sql(TOPS_SQL + ", d AS (" + " UNION ALL ".join(
    f"SELECT formation, '{c}' AS curve, count(DISTINCT well_api) FILTER (WHERE {c} IS NOT NULL) AS wells, count({c}) AS n, avg({c}) AS mean, var_pop({c}) AS variance, "
    f"any_value(ws) AS ws FROM jf JOIN (SELECT formation AS f2, stddev_samp(m) AS ws FROM (SELECT formation, well_api, avg({c}) AS m FROM jf GROUP BY ALL) GROUP BY 1) "
    f"ON formation IS NOT DISTINCT FROM f2 GROUP BY formation" for c in L_CURVES)
    + ") SELECT formation, curve, wells, n, " + R("mean") + " AS mean, " + R("variance") + " AS variance, " + R("ws") + " AS well_mean_std FROM d WHERE n > 0"))
def formation_moments(spark, sf):
    df = L(spark, sf).drop("operator_id")
    return round_doubles(FO.formation_moments(FO.in_formations(df, tops(df)), L_CURVES))


# ---------------------------------------------------------------------------------- nearest donors


def _knn_sql(curves: list[str]) -> str:
    ctes, out = [], []
    for c in curves:
        ps = [p for p in L_CURVES if p != c]
        n = len(ctes)
        dim = " + ".join(f"av_{p}::INT" for p in ps)
        shared = " + ".join(f"(q.z_{p} IS NOT NULL AND d.z_{p} IS NOT NULL)::INT" for p in ps)
        total = " + ".join(f"coalesce((q.z_{p} - d.z_{p}) * (q.z_{p} - d.z_{p}), 0.0)" for p in ps)
        some = " OR ".join(f"z_{p} IS NOT NULL" for p in ps)
        ctes.append(f"""st{n} AS (SELECT well_api, {", ".join(f"count({p}) > count(*) * 0.5 AS av_{p}, avg({p}) AS m_{p}, CASE WHEN stddev_pop({p}) = 0 THEN 1 ELSE stddev_pop({p}) END AS s_{p}" for p in ps)} FROM l GROUP BY 1),
z{n} AS MATERIALIZED (SELECT l.well_api, DEPTH, {c} AS y, {dim} AS dim, {", ".join(f"CASE WHEN av_{p} THEN ({p} - m_{p}) / s_{p} END AS z_{p}" for p in ps)} FROM l JOIN st{n} USING (well_api)),
dn{n} AS (SELECT * FROM z{n} WHERE y IS NOT NULL AND ({some})),
k{n} AS (SELECT well_api, greatest(1, least(5, count(*) // 2)) AS k FROM dn{n} GROUP BY 1 HAVING count(*) > 10),
p{n} AS (SELECT q.well_api, q.DEPTH, d.y, d.DEPTH AS dd, k, round(({total}) * q.dim / ({shared}), 9) AS d2 FROM z{n} q JOIN dn{n} d USING (well_api) JOIN k{n} USING (well_api) WHERE q.y IS NULL AND {shared} > 0),
f{n} AS (SELECT well_api, DEPTH, avg(y) AS fill FROM (SELECT *, row_number() OVER (PARTITION BY well_api, DEPTH ORDER BY d2, dd) AS r FROM p{n}) WHERE r <= k GROUP BY 1, 2)""")
        out.append(f"LEFT JOIN f{n} ON l.well_api = f{n}.well_api AND l.DEPTH = f{n}.DEPTH")
    pick = ", ".join(f"{R(f'coalesce(l.{c}, f{i}.fill)')} AS {c}" for i, c in enumerate(curves))
    return sql(", " + ", ".join(ctes) + f" SELECT l.well_api, {R('l.DEPTH')} AS DEPTH, {pick} FROM l " + " ".join(out))


@register("impute_knn", _knn_sql(["GR", "RT"]))
def impute_knn(spark, sf):
    df = L(spark, sf).drop("operator_id")
    return round_doubles(KN.knn_impute(df, ["GR", "RT"], L_CURVES).select("well_api", "DEPTH", "GR", "RT"))
