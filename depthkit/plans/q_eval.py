"""Registered evaluation queries.

The "models" are the centered rolling means of GR over 5/10/20 rows, so every evaluation
aggregate runs on predictions Spark derives from the lineitem log, at its full size."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit.operators import evaluate as EV
from depthkit.operators.blocked import in_blocks
from depthkit.operators.features import rolling_exprs
from depthkit.plans.common import L, R, register, round_doubles, sql
from depthkit.plans.q_features import _roll_sql

MODELS = [5, 10, 20]


def predictions(spark, sf):
    """Long (model, well_api, DEPTH, y, p) with one row per model and log row."""
    df = L(spark, sf).select("well_api", "DEPTH", "GR")
    wide = in_blocks(df, lambda w: {f"p{m}": rolling_exprs("GR", w, [m], quantiles=False)[f"GR_roll_mean_{m}"] for m in MODELS}, max(MODELS))
    arr = F.array(*[F.struct(F.lit(f"roll{m}").alias("model"), F.col(f"p{m}").alias("p")) for m in MODELS])
    return wide.select("well_api", "DEPTH", F.col("GR").alias("y"), F.explode(arr).alias("_m")).select(
        "_m.model", "well_api", "DEPTH", "y", "_m.p")


PRED_CTE = ", pw AS (SELECT well_api, DEPTH, GR, " + ", ".join(
    f"{_roll_sql('GR', m)[f'GR_roll_mean_{m}']} AS p{m}" for m in MODELS) + " FROM l), pr AS (" + " UNION ALL ".join(
    f"SELECT 'roll{m}' AS model, well_api, DEPTH, GR AS y, p{m} AS p FROM pw" for m in MODELS) + \
    "), ok AS (SELECT * FROM pr WHERE y IS NOT NULL AND p IS NOT NULL)"

METRIC_SQL = {
    "n": "count(*)",
    "r2": "1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0)",
    "rmse": "sqrt(sum((y - p) * (y - p)) / count(*))",
    "mae": "avg(abs(y - p))",
    "validity_pct": "avg(CAST(p BETWEEN 10 AND 250 AS DOUBLE)) * 100",
    "residual_mean": "avg(y - p)", "residual_std": "stddev_pop(y - p)",
    "pred_min": "min(p)", "pred_max": "max(p)", "pred_mean": "avg(p)", "pred_std": "stddev_pop(p)",
    "actual_min": "min(y)", "actual_max": "max(y)", "actual_mean": "avg(y)", "actual_std": "stddev_samp(y)",
}


@register("eval_metrics", sql(PRED_CTE + " SELECT model, " + ", ".join(
    (f"{v} AS {k}" if k == "n" else f"{R(v)} AS {k}") for k, v in METRIC_SQL.items()) + " FROM ok GROUP BY model"))
def eval_metrics(spark, sf):
    return round_doubles(EV.regression_metrics(predictions(spark, sf), "y", "p", ["model"]))


@register("band_r2", sql(PRED_CTE + """, b AS (SELECT *, CASE WHEN y >= 0 AND y < 75 THEN 'low' WHEN y >= 75 AND y < 150 THEN 'medium'
       WHEN y >= 150 AND y < 300 THEN 'high' END AS band FROM ok)
SELECT model, band, count(*) AS n, """ + R("1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0)") + " AS r2, "
                         + R("sqrt(avg((y - p) * (y - p)))") + " AS rmse FROM b GROUP BY model, band"))
def band_r2(spark, sf):
    return round_doubles(EV.band_r2(predictions(spark, sf), "y", "p", ["model"]))


@register("residual_hist", sql(PRED_CTE + """, r AS (SELECT model, y - p AS r FROM ok),
st AS (SELECT model, min(r) AS lo, max(r) AS hi FROM r GROUP BY model),
b AS (SELECT r.model, lo, hi, CAST(coalesce(least(floor((r - lo) / nullif((hi - lo) / 30, 0)), 29), 0) AS INTEGER) AS bin
      FROM r JOIN st USING (model))
SELECT model, bin, """ + R("lo + bin * ((hi - lo) / 30)") + " AS bin_lo, " + R("lo + (bin + 1) * ((hi - lo) / 30)")
                               + " AS bin_hi, count(*) AS count FROM b GROUP BY model, bin, lo, hi"))
def residual_hist(spark, sf):
    return round_doubles(EV.residual_histogram(predictions(spark, sf), "y", "p", 30, ["model"]))


@register("depth_error", sql(PRED_CTE + " SELECT model, well_api, " + R("floor(DEPTH / 100.0) * 100.0") + " AS depth_bin, count(*) AS n, "
                             + R("avg(abs(y - p))") + " AS mae FROM ok GROUP BY model, well_api, floor(DEPTH / 100.0)"))
def depth_error(spark, sf):
    out = EV.depth_error(predictions(spark, sf), "y", "p", ["model", "well_api"])
    return round_doubles(out.withColumn("depth_bin", F.col("depth_bin").cast("double")))


FOLD_SQL = PRED_CTE + """, fm AS (SELECT model, well_api % 5 AS fold,
       1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM ok GROUP BY model, well_api % 5),
cs AS (SELECT model, count(*) AS folds, avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std FROM fm GROUP BY model)
"""


def _fold_metrics(spark, sf):
    p = predictions(spark, sf).withColumn("fold", F.col("well_api") % 5)
    return EV.regression_metrics(p, "y", "p", ["model", "fold"])


@register("cv_summary", sql(FOLD_SQL + "SELECT model, folds, " + R("cv_mean") + " AS cv_mean, " + R("cv_std") + " AS cv_std FROM cs"))
def cv_summary(spark, sf):
    return round_doubles(EV.cv_summary(_fold_metrics(spark, sf)))


@register("best_model", sql(FOLD_SQL + "SELECT model, " + R("cv_mean") + " AS cv_mean FROM cs ORDER BY cv_mean DESC, model LIMIT 1"))
def best_model(spark, sf):
    cs = EV.cv_summary(_fold_metrics(spark, sf))
    return round_doubles(cs.orderBy(F.col("cv_mean").desc(), "model").limit(1).select("model", "cv_mean"))


TOPF = ["RHOB", "NPHI", "RT", "PE"]


def _top_features_sql() -> str:
    body = ", pw AS (SELECT GR, RHOB, NPHI, RT, PE, " + ", ".join(
        f"{_roll_sql('GR', m)[f'GR_roll_mean_{m}']} AS GR_roll_mean_{m}" for m in MODELS) + " FROM l), c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr({c}, GR)) AS importance FROM pw" for c in TOPF + [f"GR_roll_mean_{m}" for m in MODELS]) + ")"
    return sql(body + " SELECT feature, " + R("importance") + " AS importance FROM c ORDER BY importance DESC, feature LIMIT 5")


@register("top_features", _top_features_sql())
def top_features(spark, sf):
    df = L(spark, sf)
    df = in_blocks(df, lambda w: {f"GR_roll_mean_{m}": rolling_exprs("GR", w, [m], quantiles=False)[f"GR_roll_mean_{m}"] for m in MODELS}, max(MODELS))
    feats = TOPF + [f"GR_roll_mean_{m}" for m in MODELS]
    wide = df.agg(*[F.abs(F.corr(c, "GR")).alias(c) for c in feats])
    stack = ", ".join(f"'{c}', `{c}`" for c in feats)
    long = wide.selectExpr(f"stack({len(feats)}, {stack}) as (feature, importance)")
    return round_doubles(EV.top_k(long, "importance", "feature", 5))


ATTR_FEATS = {
    "GR_roll_mean_5": None, "GR_roll_mean_20": None, "GR_diff_1": None,
    "RHOB": "RHOB", "NPHI": "NPHI", "RT": "RT", "PE": "PE", "RT_PE_ratio": "RT / (PE + 1e-8)",
}


def _attr_frame(spark, sf):
    df = L(spark, sf)

    def exprs(w):
        ro = rolling_exprs("GR", w, [5, 20], quantiles=False)
        return {"GR_roll_mean_5": ro["GR_roll_mean_5"], "GR_roll_mean_20": ro["GR_roll_mean_20"], "GR_diff_1": F.col("GR") - F.lag("GR", 1).over(w)}

    return in_blocks(df, exprs, 20).withColumn("RT_PE_ratio", F.try_divide(F.col("RT"), F.col("PE") + 1e-8))


def _attr_sql() -> str:
    feats = list(ATTR_FEATS)
    fw = ", fw AS (SELECT GR, RHOB, NPHI, RT, PE, " + _roll_sql("GR", 5)["GR_roll_mean_5"] + " AS GR_roll_mean_5, " + \
        _roll_sql("GR", 20)["GR_roll_mean_20"] + " AS GR_roll_mean_20, GR - lag(GR, 1) OVER (PARTITION BY well_api ORDER BY DEPTH) AS GR_diff_1, " \
        "RT / nullif(PE + 1e-8, 0) AS RT_PE_ratio FROM l)"
    st = ", st AS (SELECT " + ", ".join(f"regr_slope(GR, {c}) AS b_{c}, avg({c}) AS m_{c}" for c in feats) + " FROM fw WHERE GR IS NOT NULL)"
    lg = ", lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, ({c} - m_{c}) * b_{c} AS a FROM fw CROSS JOIN st" for c in feats) + ")"
    per = ", per AS (SELECT feature, avg(abs(a)) AS mean_abs, CASE WHEN feature LIKE '%\\_roll\\_%' ESCAPE '\\' THEN 'rolling' " \
          "WHEN feature LIKE '%gradient%' OR feature LIKE '%\\_diff\\_%' ESCAPE '\\' OR feature LIKE '%\\_pct\\_change%' ESCAPE '\\' OR feature LIKE '%curvature%' THEN 'gradient' " \
          "WHEN feature LIKE '%\\_ratio%' ESCAPE '\\' OR feature LIKE '%\\_product%' ESCAPE '\\' THEN 'ratio' ELSE 'base' END AS family FROM lg WHERE a IS NOT NULL GROUP BY feature)"
    return sql(fw + st + lg + per + " SELECT family, " + R("sum(mean_abs)") + " AS total, count(*) AS features FROM per GROUP BY family")


@register("family_attribution", _attr_sql())
def family_attribution(spark, sf):
    df = _attr_frame(spark, sf)
    long = EV.linear_attributions(df, "GR", list(ATTR_FEATS))
    return round_doubles(EV.family_attribution(long))
