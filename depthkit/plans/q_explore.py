"""Registered exploratory queries (D1-D19) and their oracles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from depthkit.operators import clean as CL
from depthkit.operators import explore as EX
from depthkit.plans.common import E, L, L_CURVES, R, register, round_doubles, sql

W = "PARTITION BY well_api ORDER BY DEPTH"
UP = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ON = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _e(spark, sf):
    return E(spark, sf).select("well_api", "DEPTH", "GR")


def _l(spark, sf):
    return L(spark, sf).drop("operator_id")


@register("well_inventory", sql(f""",
s AS (SELECT *, DEPTH - lag(DEPTH) OVER ({W}) AS st FROM l),
a AS (SELECT well_api, count(*) AS n_rows, min(DEPTH) AS min_depth, max(DEPTH) AS max_depth,
             concat_ws(',', {", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in sorted(L_CURVES))}) AS curves,
             median(st) AS median_step FROM s GROUP BY well_api)
SELECT well_api, n_rows, {R("min_depth")} AS min_depth, {R("max_depth")} AS max_depth, curves, {R("median_step")} AS median_step,
       CASE WHEN median_step > 0 THEN 'down' WHEN median_step < 0 THEN 'up' ELSE 'flat' END AS direction FROM a"""))
def well_inventory(spark, sf):
    return round_doubles(EX.well_inventory(_l(spark, sf), L_CURVES))


@register("curve_combinations", sql(f""",
p AS (SELECT well_api, concat_ws(',', {", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in sorted(L_CURVES))}) AS combination
      FROM l GROUP BY well_api)
SELECT combination, count(*) AS wells FROM p GROUP BY combination"""))
def curve_combinations(spark, sf):
    return EX.curve_combinations(_l(spark, sf), L_CURVES)


@register("valid_interval", sql(", r AS (SELECT well_api, min(DEPTH) AS mn, max(DEPTH) AS mx FROM l GROUP BY well_api), v AS ("
                                + " UNION ALL ".join(f"SELECT well_api, '{c}' AS curve, min(CASE WHEN {c} IS NOT NULL THEN DEPTH END) AS fv, "
                                                     f"max(CASE WHEN {c} IS NOT NULL THEN DEPTH END) AS lv FROM l GROUP BY well_api" for c in L_CURVES)
                                + ") SELECT v.well_api, curve, " + R("fv") + " AS first_valid, " + R("lv") + " AS last_valid, "
                                + R("(lv - fv) / nullif(mx - mn, 0) * 100") + " AS valid_pct, coalesce((lv - fv) / nullif(mx - mn, 0) * 100 < 50, true) AS short "
                                "FROM v JOIN r USING (well_api)"))
def valid_interval(spark, sf):
    return round_doubles(EX.valid_interval(_l(spark, sf), L_CURVES))


def _dist_sql() -> str:
    parts = []
    for c in L_CURVES:
        parts.append(f"""SELECT '{c}' AS curve, count({c}) AS n, min({c}) AS mn, max({c}) AS mx, avg({c}) AS av, stddev_samp({c}) AS sd,
  avg(power({c} - m_{c}, 3)) / power(avg(power({c} - m_{c}, 2)), 1.5) AS sk,
  avg(power({c} - m_{c}, 4)) / power(avg(power({c} - m_{c}, 2)), 2) - 3 AS ku,
  quantile_cont({c}, 0.01) AS p1, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
  quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.99) AS p99 FROM l CROSS JOIN mu""")
    mu = ", mu AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in L_CURVES) + " FROM l)"
    return sql(mu + ", d AS (" + " UNION ALL ".join(parts) + ") SELECT curve, n, " + ", ".join(
        f"{R(a)} AS {b}" for a, b in [("mn", "min"), ("mx", "max"), ("av", "mean"), ("sd", "std"), ("sk", "skew"), ("ku", "kurtosis"),
                                      ("p1", "p1"), ("p25", "p25"), ("p50", "median"), ("p75", "p75"), ("p99", "p99")]) + " FROM d")


@register("curve_distribution", _dist_sql())
def curve_distribution(spark, sf):
    return round_doubles(EX.curve_distribution(_l(spark, sf), L_CURVES))


@register("well_boxplot", sql(""",
q AS (SELECT well_api, quantile_cont(GR, 0.25) AS q1, median(GR) AS med, quantile_cont(GR, 0.75) AS q3 FROM e GROUP BY well_api),
j AS (SELECT e.well_api, GR, q1, q3, q3 - q1 AS iqr FROM e JOIN q ON e.well_api IS NOT DISTINCT FROM q.well_api WHERE GR IS NOT NULL),
w AS (SELECT well_api, min(CASE WHEN GR >= q1 - 1.5 * iqr THEN GR END) AS wl, max(CASE WHEN GR <= q3 + 1.5 * iqr THEN GR END) AS wh,
             count(*) FILTER (WHERE GR < q1 - 1.5 * iqr OR GR > q3 + 1.5 * iqr) AS n_fliers FROM j GROUP BY well_api)
SELECT q.well_api, """ + R("q1") + " AS q1, " + R("med") + " AS median, " + R("q3") + " AS q3, " + R("q3 - q1") + " AS iqr, "
                              + R("wl") + " AS whisker_lo, " + R("wh") + " AS whisker_hi, coalesce(n_fliers, 0) AS n_fliers FROM q LEFT JOIN w ON q.well_api IS NOT DISTINCT FROM w.well_api"))
def well_boxplot(spark, sf):
    return round_doubles(EX.well_boxplot(_e(spark, sf), "GR"))


@register("gap_runs", sql(f""",
t AS (SELECT well_api, DEPTH, GR IS NULL AS is_gap, count(GR) {UP} AS run,
             last_value(CASE WHEN GR IS NOT NULL THEN DEPTH END IGNORE NULLS) {UP} AS pv,
             first_value(CASE WHEN GR IS NOT NULL THEN DEPTH END IGNORE NULLS) {ON} AS nv FROM e)
SELECT well_api, {R("min(DEPTH)")} AS start_depth, {R("max(DEPTH)")} AS end_depth, count(*) AS n_rows,
       {R("any_value(nv) - any_value(pv)")} AS gap_length
FROM t WHERE is_gap GROUP BY well_api, run"""))
def gap_runs(spark, sf):
    return round_doubles(EX.gap_runs(_e(spark, sf), "GR"))


@register("co_missing", sql(" SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS curve_a, '{b}' AS curve_b, {R(f'avg(CAST({a} IS NULL AND {b} IS NULL AS DOUBLE)) * 100')} AS both_null_pct FROM l"
    for a, b in combinations(L_CURVES, 2)) + ")"))
def co_missing(spark, sf):
    return round_doubles(EX.co_missing(_l(spark, sf), L_CURVES))


@register("pair_corr", sql(" SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS curve_a, '{b}' AS curve_b, regr_count({b}, {a}) AS n, {R(f'corr({a}, {b})')} AS corr, "
    f"{R(f'regr_slope({b}, {a})')} AS slope, {R(f'regr_intercept({b}, {a})')} AS intercept FROM l"
    for a, b in combinations(L_CURVES, 2)) + ")"))
def pair_corr(spark, sf):
    return round_doubles(EX.pair_corr(_l(spark, sf), L_CURVES))


@register("smoothing", sql(f" SELECT well_api, {R('DEPTH')} AS DEPTH, {R('GR')} AS GR, "
                           f"{R(f'avg(GR) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS GR_ma_5, "
                           f"{R(f'quantile_cont(GR, 0.5) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS GR_rmed_5 FROM e"))
def smoothing(spark, sf):
    return round_doubles(EX.smoothing(_e(spark, sf), "GR", 5))


LAGS = [1, 2, 5, 10, 20]


@register("autocorr", sql(", t AS (SELECT GR, " + ", ".join(f"lag(GR, {k}) OVER ({W}) AS l{k}" for k in LAGS) + " FROM e), "
                          "a AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, corr(GR, l{k}) AS r FROM t" for k in LAGS) + "), "
                          "f AS (SELECT min(lag) AS correlation_length FROM a WHERE r < 0.3) "
                          "SELECT CAST(lag AS INTEGER) AS lag, " + R("r") + " AS autocorr, CAST(correlation_length AS INTEGER) AS correlation_length FROM a CROSS JOIN f"))
def autocorr(spark, sf):
    return round_doubles(EX.autocorrelation(_e(spark, sf), "GR", LAGS))


@register("mad_iqr_flags", sql(f""",
q AS (SELECT well_api, quantile_cont(GR, 0.25) AS q1, median(GR) AS med, quantile_cont(GR, 0.75) AS q3 FROM e GROUP BY well_api),
m AS (SELECT e.well_api, median(abs(GR - med)) AS mad FROM e JOIN q USING (well_api) GROUP BY e.well_api),
j AS (SELECT e.*, coalesce(abs(0.6745 * (GR - med) / nullif(mad, 0)) > 3.5, false) AS mad_flag,
             coalesce(GR < q1 - 1.5 * (q3 - q1) OR GR > q3 + 1.5 * (q3 - q1), false) AS iqr_flag
      FROM e JOIN q USING (well_api) JOIN m USING (well_api))
SELECT well_api, {R("DEPTH")} AS DEPTH, {R("GR")} AS GR, mad_flag, iqr_flag,
       CASE WHEN NOT iqr_flag THEN NULL WHEN coalesce(lag(iqr_flag) OVER ({W}), false) OR coalesce(lead(iqr_flag) OVER ({W}), false)
            THEN 'interval' ELSE 'spike' END AS outlier_kind FROM j"""))
def mad_iqr_flags(spark, sf):
    return round_doubles(EX.mad_iqr_flags(_e(spark, sf), "GR"))


@register("winsorize", sql(", p AS (SELECT quantile_cont(GR, 0.01) AS lo, quantile_cont(GR, 0.99) AS hi FROM e) "
                           "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("CASE WHEN GR IS NULL THEN NULL ELSE least(greatest(GR, lo), hi) END")
                           + " AS GR FROM e CROSS JOIN p"))
def winsorize(spark, sf):
    return round_doubles(CL.winsorize(_e(spark, sf), ["GR"]))


@register("running_moments", sql(f" SELECT well_api, {R('DEPTH')} AS DEPTH, {R('GR')} AS GR, "
                                 f"{R(f'avg(GR) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS GR_run_mean_20, "
                                 f"{R(f'var_samp(GR) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS GR_run_var_20 FROM e"))
def running_moments(spark, sf):
    return round_doubles(EX.running_moments(_e(spark, sf), "GR", 20))


@register("zscore_by_well", sql(", g AS (SELECT well_api, avg(GR) AS gm, stddev_samp(GR) AS gs FROM l GROUP BY well_api), "
                                "a AS (SELECT avg(GR) AS am, stddev_samp(GR) AS s FROM l) "
                                "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR, " + R("(GR - gm) / nullif(gs, 0)")
                                + " AS GR_z_well, " + R("(GR - am) / nullif(s, 0)") + " AS GR_z_global, "
                                + R("CASE WHEN RT > 0 THEN log10(RT) END") + " AS log_rt FROM l JOIN g USING (well_api) CROSS JOIN a"))
def zscore_by_well(spark, sf):
    df = _l(spark, sf).select("well_api", "DEPTH", "GR", "RT")
    out = EX.zscores(df, "GR").withColumn("log_rt", F.log10("RT")).drop("RT")
    return round_doubles(out)


@register("feasibility", sql(", w AS (SELECT well_api, " + ", ".join(f"count({c}) * 100.0 / count(*) AS p_{c}" for c in L_CURVES)
                             + " FROM l GROUP BY well_api) SELECT * FROM (" + " UNION ALL ".join(
                                 f"SELECT '{c}' AS curve, count(*) FILTER (WHERE p_{c} >= 80) AS wells_ok, count(*) AS wells_total FROM w" for c in L_CURVES) + ")"))
def feasibility(spark, sf):
    return EX.target_feasibility(_l(spark, sf), L_CURVES)


@register("gap_policy", sql(f""",
t AS (SELECT *, last_value(CASE WHEN GR IS NOT NULL THEN DEPTH END IGNORE NULLS) {UP} AS pd,
             last_value(GR IGNORE NULLS) {UP} AS pv,
             first_value(CASE WHEN GR IS NOT NULL THEN DEPTH END IGNORE NULLS) {ON} AS nd,
             first_value(GR IGNORE NULLS) {ON} AS nv FROM e)
SELECT well_api, {R("DEPTH")} AS DEPTH, {R("GR")} AS GR,
       {R("CASE WHEN GR IS NOT NULL THEN GR WHEN nd - pd < 10.0 THEN (nv - pv) / (nd - pd) * (DEPTH - pd) + pv END")} AS GR_filled,
       GR IS NULL AND (pd IS NULL OR nd IS NULL OR nd - pd > 100.0) AS do_not_train FROM t"""))
def gap_policy(spark, sf):
    return round_doubles(EX.gap_policy(_e(spark, sf), "GR"))


@register("mahalanobis", sql("""
, k AS MATERIALIZED (SELECT well_api, DEPTH, RHOB, PE FROM l),
s AS MATERIALIZED (SELECT avg(RHOB) AS ma, avg(PE) AS mb, var_pop(RHOB) AS vaa, var_pop(PE) AS vbb, covar_pop(RHOB, PE) AS vab
      FROM k WHERE RHOB IS NOT NULL AND PE IS NOT NULL),
x AS MATERIALIZED (SELECT well_api, DEPTH, sqrt(((RHOB - ma) * (RHOB - ma) * vbb - 2 * (RHOB - ma) * (PE - mb) * vab
       + (PE - mb) * (PE - mb) * vaa) / nullif(vaa * vbb - vab * vab, 0)) AS m FROM k CROSS JOIN s)
SELECT well_api, """ + R("DEPTH") + " AS DEPTH, " + R("m") + " AS mahalanobis FROM x"))
def mahalanobis(spark, sf):
    df = _l(spark, sf).select("well_api", "DEPTH", "RHOB", "PE")
    return round_doubles(EX.mahalanobis2(df, "RHOB", "PE").drop("RHOB", "PE"))


@register("neighbor_features", sql(" SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR, " + ", ".join(
    f"{R(f'lag(GR, {j}) OVER ({W})')} AS GR_prev_{j}, {R(f'lead(GR, {j}) OVER ({W})')} AS GR_next_{j}" for j in (1, 2, 3)) + " FROM e"))
def neighbor_features(spark, sf):
    return round_doubles(EX.neighbor_features(_e(spark, sf), "GR", 3))
