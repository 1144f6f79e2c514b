"""Registered split / scaling / target-preparation queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit.functions.exprs import boxcox_expr
from depthkit.operators import impute as IM
from depthkit.operators import scale as SC
from depthkit.operators import split as SP
from depthkit.operators.evaluate import original_scale_metrics
from depthkit.operators.models import with_folds
from depthkit.plans.common import E, L, L_CURVES, R, register, round_doubles, sql
from depthkit.session import scratch_path
from depthkit.sinks.writers import write_table

MD5 = "md5(CAST(well_api AS VARCHAR) || ':42')"

SPLIT_CTE = f""",
wl AS (SELECT DISTINCT well_api FROM l),
o AS (SELECT well_api, row_number() OVER (ORDER BY {MD5}, well_api) - 1 AS r, count(*) OVER () AS n FROM wl),
c AS (SELECT *, greatest(1, floor(n * CAST(0.6 AS DOUBLE))) AS nt, greatest(1, floor(n * CAST(0.2 AS DOUBLE))) AS nv0 FROM o),
d AS (SELECT *, CASE WHEN n - nt - nv0 < 1 THEN greatest(0, n - nt - 1) ELSE nv0 END AS nv FROM c),
sp AS (SELECT well_api, CASE WHEN r < nt THEN 'train' WHEN r < nt + nv THEN 'validation' ELSE 'test' END AS split FROM d)
"""


def _splits(spark, sf):
    return SP.split_wells(L(spark, sf), 0.6, 0.2)


@register("split_wells", sql(SPLIT_CTE + "SELECT well_api, split FROM sp"))
def split_wells(spark, sf):
    return _splits(spark, sf)


@register("split_by_operator", sql(f""",
wl AS (SELECT well_api, min(operator_id) AS op FROM l GROUP BY well_api),
o AS (SELECT well_api, row_number() OVER (PARTITION BY op ORDER BY {MD5}, well_api) - 1 AS r,
             count(*) OVER (PARTITION BY op) AS n FROM wl)
SELECT well_api, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN r = 0 THEN 'train' ELSE 'test' END
            WHEN r < greatest(1, floor(n * CAST(0.6 AS DOUBLE))) THEN 'train'
            WHEN r < greatest(1, floor(n * CAST(0.6 AS DOUBLE))) + greatest(0, floor(n * CAST(0.0 AS DOUBLE))) THEN 'validation'
            ELSE 'test' END AS split FROM o"""))
def split_by_operator(spark, sf):
    return SP.split_wells(L(spark, sf), 0.6, 0.0, operator="operator_id")


def _split_stats_sql() -> str:
    comp = " + ".join(f"count({c}) / count(*)" for c in L_CURVES)
    return sql(SPLIT_CTE + f""",
t AS (SELECT count(*) AS total FROM l)
SELECT split, count(DISTINCT well_api) AS wells, count(*) AS records,
       {R(f'({comp}) / {len(L_CURVES)}.0 * 100.0')} AS completeness_pct,
       {R('count(*) / any_value(total)')} AS ratio_actual
FROM l JOIN sp USING (well_api) CROSS JOIN t GROUP BY split""")


@register("split_stats", _split_stats_sql())
def split_stats(spark, sf):
    df = L(spark, sf)
    return round_doubles(SP.split_stats(df, _splits(spark, sf), features=L_CURVES))


@register("wells_per_operator", sql(
    ", wl AS (SELECT well_api, arg_min(operator_id, DEPTH) AS operator_id FROM l GROUP BY well_api) "
    "SELECT operator_id, count(*) AS wells FROM wl GROUP BY operator_id"))
def wells_per_operator(spark, sf):
    return SP.wells_per_operator(L(spark, sf), operator="operator_id")


@register("well_order", sql(f", wl AS (SELECT DISTINCT well_api FROM l) SELECT well_api, "
                            f"CAST(row_number() OVER (ORDER BY {MD5}, well_api) - 1 AS INTEGER) AS rank, count(*) OVER () AS n FROM wl"))
def well_order(spark, sf):
    return SP.well_order(L(spark, sf))


@register("stable_sample", sql(
    ", k AS (SELECT *, md5(CAST(well_api AS VARCHAR) || '|' || CAST(CAST(DEPTH AS BIGINT) AS VARCHAR) || ':42') AS h FROM l) "
    "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR FROM k ORDER BY h, well_api, DEPTH LIMIT 1000"))
def stable_sample(spark, sf):
    df = L(spark, sf).withColumn("_d", F.col("DEPTH").cast("long"))
    return round_doubles(SP.stable_sample(df, ["well_api", "_d"], 1000).select("well_api", "DEPTH", "GR"))


def _scaled_sql(kind: str) -> str:
    if kind == "standard":
        st = ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in L_CURVES)
        ex = {c: f"({c} - a_{c}) / s_{c}" for c in L_CURVES}
    elif kind == "minmax":
        st = ", ".join(f"min({c}) AS a_{c}, CASE WHEN max({c}) - min({c}) = 0 THEN 1 ELSE max({c}) - min({c}) END AS s_{c}" for c in L_CURVES)
        ex = {c: f"({c} - a_{c}) / s_{c}" for c in L_CURVES}
    else:
        st = ", ".join(
            f"quantile_cont({c}, 0.5) AS a_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1 "
            f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in L_CURVES)
        ex = {c: f"({c} - a_{c}) / s_{c}" for c in L_CURVES}
    return sql(f", m AS MATERIALIZED (SELECT * FROM l), st AS MATERIALIZED (SELECT {st} FROM m), x AS MATERIALIZED (SELECT well_api, DEPTH, "
               + ", ".join(f"{v} AS {k}" for k, v in ex.items()) + f" FROM m CROSS JOIN st) SELECT well_api, {R('DEPTH')} AS DEPTH, "
               + ", ".join(f"{R(k)} AS {k}" for k in ex) + " FROM x")


def _scale_q(kind: str, fn):
    def q(spark, sf):
        df = L(spark, sf).drop("operator_id")
        return round_doubles(fn(df, L_CURVES))
    register(f"scale_{kind}", _scaled_sql(kind))(q)


_scale_q("standard", SC.scale_standard)
_scale_q("minmax", SC.scale_minmax)
_scale_q("robust", SC.scale_robust)


TRAIN_CTE = """, f AS (
  SELECT well_api, (row_number() OVER (ORDER BY md5(CAST(well_api AS VARCHAR) || ':42')) - 1) % 5 AS fold FROM (SELECT DISTINCT well_api FROM l)),
tr AS (SELECT l.* FROM l JOIN f USING (well_api) WHERE fold <> 0)"""


@register("scaler_saved", sql(TRAIN_CTE + ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in L_CURVES)
    + " FROM tr) SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + ", ".join(f"{R(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in L_CURVES)
    + " FROM l CROSS JOIN st"))
def scaler_saved(spark, sf):
    """Fit on the training wells, write the fitted table, read it back, apply it to all wells."""
    df = L(spark, sf).drop("operator_id")
    train = with_folds(df).filter("fold <> 0")
    path = scratch_path(spark, "scaler")
    write_table(SC.fit_scaler(train, L_CURVES), path)
    return round_doubles(SC.apply_scaler(df, spark.read.parquet(path)))


@register("original_scale", sql(""", w AS (
  SELECT well_api, GR, avg(GR) OVER (PARTITION BY well_api) AS p FROM l WHERE GR IS NOT NULL)
SELECT count(*) AS n, """ + R("1 - sum((GR - p) * (GR - p)) / (var_pop(GR) * count(*))") + " AS r2, " + R("sqrt(avg((GR - p) * (GR - p)))") + " AS rmse, "
    + R("avg(abs(GR - p))") + " AS mae FROM w"))
def original_scale(spark, sf):
    """Metrics of well means as predictions, from values on the Box-Cox scale (lambda 0.5, mean 9, std 4)."""
    df = L(spark, sf).select("well_api", "GR").filter(F.col("GR").isNotNull())
    means = df.groupBy("well_api").agg(F.avg("GR").alias("p"))
    to = lambda c: (boxcox_expr(c, 0.5) - 9.0) / 4.0
    scaled = df.join(means, "well_api").select("well_api", to("GR").alias("y"), to("p").alias("p"))
    return round_doubles(original_scale_metrics(scaled, "y", "p", 0.5, 9.0, 4.0).select("n", "r2", "rmse", "mae"))


@register("zscore_filter", sql(
    ", st AS (SELECT avg(GR) AS m, stddev_pop(GR) AS s FROM e) SELECT well_api, " + R("DEPTH") + " AS DEPTH, "
    + R("GR") + " AS GR FROM e CROSS JOIN st WHERE GR IS NULL OR abs(GR - m) / s <= 3.0"))
def zscore_filter(spark, sf):
    df = E(spark, sf).select("well_api", "DEPTH", "GR")
    return round_doubles(SC.zscore_filter(df, "GR", 3.0))


BOXCOX_CTE = """,
v AS (SELECT GR AS x FROM e WHERE GR IS NOT NULL),
g AS (SELECT CAST(k AS DOUBLE) / 100.0 AS lam FROM range(-200, 201) t(k)),
p AS (SELECT lam, count(*) AS n, sum(ln(x)) AS sl,
             var_pop(CASE WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END) AS var
      FROM v CROSS JOIN g GROUP BY lam),
ll AS (SELECT lam, (lam - 1) * sl - n / 2.0 * ln(var) AS loglik, n FROM p),
best AS (SELECT lam, loglik, n FROM ll ORDER BY loglik DESC, lam LIMIT 1)
"""


def _best_lambda(df):
    """Two-level grid (0.1 then 0.01 inside +/-0.1) over [-2, 2]."""
    lam, ll = SC.fit_boxcox(df, "GR", -2.0, 2.0, steps=(0.1, 0.01))
    return lam, ll


@register("boxcox_loglik", sql(BOXCOX_CTE + "SELECT " + R("lam") + " AS lambda, " + R("loglik") + " AS loglik, n FROM best"))
def boxcox_loglik(spark, sf):
    df = E(spark, sf).select("GR")
    lam, _ = _best_lambda(df)
    prof = SC.boxcox_profile(df, "GR", [lam])
    return round_doubles(prof.select("lambda", "loglik", "n"))


@register("boxcox_transform", sql(BOXCOX_CTE + """,
t AS (SELECT well_api, DEPTH, CASE WHEN lam = 0 THEN ln(GR) ELSE (pow(GR, lam) - 1) / lam END AS y FROM e CROSS JOIN best),
s AS (SELECT avg(y) AS m, stddev_pop(y) AS sd FROM t)
SELECT well_api, """ + R("DEPTH") + " AS DEPTH, " + R("(y - m) / sd") + " AS GR_transformed FROM t CROSS JOIN s"))
def boxcox_transform(spark, sf):
    df = E(spark, sf).select("well_api", "DEPTH", "GR")
    lam, _ = _best_lambda(df.select("GR"))
    out, _ = SC.boxcox_transform(df, "GR", lam=lam)
    return round_doubles(out.select("well_api", "DEPTH", "GR_transformed"))


@register("completeness_filter", sql(
    "SELECT feature, " + R("p") + " AS completeness, p > 0.5 AS kept FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NOT NULL AS DOUBLE)) AS p FROM l" for c in L_CURVES) + ")"))
def completeness_filter(spark, sf):
    return round_doubles(SC.completeness_table(L(spark, sf), L_CURVES))


@register("common_features", sql(SPLIT_CTE + ", j AS (SELECT * FROM l JOIN sp USING (well_api)), per AS ("
                                 + " UNION ALL ".join(f"SELECT '{c}' AS feature, split, avg(CAST({c} IS NOT NULL AS DOUBLE)) AS p FROM j GROUP BY split" for c in L_CURVES)
                                 + ") SELECT feature FROM per GROUP BY feature HAVING min(CAST(p > 0.5 AS INTEGER)) = 1"))
def common_features(spark, sf):
    df = SP.assign_split(L(spark, sf), _splits(spark, sf))
    return SC.common_features(df, L_CURVES)


@register("missing_totals", sql(
    ", m AS (SELECT well_api, " + ", ".join(f"median({c}) AS m_{c}" for c in L_CURVES) + " FROM l GROUP BY well_api) "
    "SELECT (SELECT CAST(" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in L_CURVES) + " AS BIGINT) FROM l) AS missing_before, "
    "(SELECT CAST(" + " + ".join(f"count(*) FILTER (WHERE coalesce({c}, m_{c}) IS NULL)" for c in L_CURVES) + " AS BIGINT) FROM l JOIN m USING (well_api)) AS missing_after"))
def missing_totals(spark, sf):
    df = L(spark, sf).drop("operator_id")
    return SC.missing_totals(df, IM.impute_median(df, L_CURVES), L_CURVES)


@register("target_rows", sql("SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + ", ".join(f"{R(c)} AS {c}" for c in L_CURVES)
                             + " FROM l WHERE GR IS NOT NULL"))
def target_rows(spark, sf):
    from depthkit.operators.evaluate import target_rows as tr
    return round_doubles(tr(L(spark, sf).drop("operator_id"), "GR"))


@register("target_bands", sql(
    ", b AS (SELECT GR, CASE WHEN GR >= 0 AND GR < 75 THEN 'low' WHEN GR >= 75 AND GR < 150 THEN 'medium' "
    "WHEN GR >= 150 AND GR < 300 THEN 'high' END AS band FROM l WHERE GR IS NOT NULL) "
    "SELECT band, count(*) AS n, " + R("avg(GR)") + " AS mean_gr FROM b GROUP BY band"))
def target_bands(spark, sf):
    from depthkit.operators.evaluate import band_expr
    df = L(spark, sf).filter(F.col("GR").isNotNull())
    return round_doubles(df.groupBy(band_expr("GR").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("GR").alias("mean_gr")))


@register("prepare_target", sql(BOXCOX_CTE + """,
t AS (SELECT well_api, DEPTH, CASE WHEN lam = 0 THEN ln(GR) ELSE (pow(GR, lam) - 1) / lam END AS y FROM e CROSS JOIN best),
s AS (SELECT avg(y) AS m, stddev_pop(y) AS sd FROM t), z AS (SELECT well_api, DEPTH, (y - m) / sd AS y FROM t CROSS JOIN s),
k AS (SELECT * FROM z CROSS JOIN (SELECT avg(y) AS ym, stddev_pop(y) AS ys FROM z) WHERE y IS NULL OR abs(y - ym) / ys <= 3.0),
d AS (SELECT avg(DEPTH) AS dm, stddev_pop(DEPTH) AS ds FROM k)
SELECT well_api, """ + R("(DEPTH - dm) / ds") + " AS depth_scaled, " + R("y") + " AS GR_transformed FROM k CROSS JOIN d"))
def prepare_target(spark, sf):
    """Box-Cox, outliers on the transformed scale, scaling: the order of the model stage."""
    df = E(spark, sf).select("well_api", F.col("DEPTH").alias("depth_scaled"), "GR")
    lam, _ = _best_lambda(df.select("GR"))
    out, _ = SC.prepare_target(df, "GR", ["depth_scaled"], lam=lam)
    return round_doubles(out.select("well_api", "depth_scaled", "GR_transformed"))


@register("prepare_target_test_mode", sql(
    ", st AS (SELECT avg(GR) AS m, stddev_pop(GR) AS s FROM e) SELECT well_api, " + R("DEPTH") + " AS DEPTH, "
    + R("GR") + " AS GR_transformed FROM e CROSS JOIN st WHERE GR IS NULL OR abs(GR - m) / s <= 5.0"))
def prepare_target_test_mode(spark, sf):
    out, _ = SC.prepare_target(E(spark, sf).select("well_api", "DEPTH", "GR"), "GR", test_mode=True)
    return round_doubles(out.select("well_api", "DEPTH", "GR_transformed"))
