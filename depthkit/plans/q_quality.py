"""Registered QC queries (P3, P4, A1-A6, A9-A11, D3) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit.operators import quality as Q
from depthkit.operators.clean import clip_ranges
from depthkit.plans.common import E, L, L_CURVES, ORACLES, R, register, round_doubles, sql


@register("null_sentinel_pct", sql(
    "SELECT well_api, 'GR' AS curve, " + R("(count(*) - count(GR)) * 100.0 / count(*)") + " AS null_pct, "
    "CAST((count(*) - count(GR)) * 100.0 / count(*) AS DOUBLE) > 10 AS flagged FROM e GROUP BY well_api"))
def null_sentinel_pct(spark, sf):
    return round_doubles(Q.null_report(E(spark, sf), ["GR"]))


@register("qc_target_stats", sql(
    "SELECT well_api, count(*) AS n_rows, " + R("min(GR)") + " AS gr_min, " + R("max(GR)") + " AS gr_max, "
    + R("avg(GR)") + " AS gr_mean, " + R("stddev_samp(GR)") + " AS gr_std, "
    + R("count(GR) * 100.0 / count(*)") + " AS gr_completeness, "
    "count(*) FILTER (WHERE GR < 10) AS below_min, count(*) FILTER (WHERE GR > 250) AS above_max "
    "FROM e GROUP BY well_api"))
def qc_target_stats(spark, sf):
    return round_doubles(Q.target_stats(E(spark, sf), "GR"))


MAD_SQL = sql(""",
v AS (SELECT well_api, GR AS x FROM e WHERE GR IS NOT NULL),
m AS (SELECT well_api, median(x) AS med FROM v GROUP BY well_api),
d AS (SELECT v.well_api, abs(x - med) AS dev FROM v JOIN m USING (well_api)),
mad AS (SELECT well_api, median(dev) AS mad FROM d GROUP BY well_api),
lim AS (SELECT well_api, med, mad, med + 5.0 * mad AS lim FROM m JOIN mad USING (well_api)),
c AS (SELECT v.well_api, count(*) AS n_valid, count(*) FILTER (WHERE x > lim) AS n_outliers
      FROM v JOIN lim USING (well_api) GROUP BY v.well_api)
SELECT well_api, """ + R("med") + " AS median, " + R("mad") + " AS mad, " + R("lim") + """ AS "limit",
       n_valid, n_outliers, n_outliers > n_valid * 0.01 AS flagged
FROM lim JOIN c USING (well_api)""")


@register("mad_outliers", MAD_SQL)
def mad_outliers(spark, sf):
    return round_doubles(Q.mad_outliers(E(spark, sf), "GR"))


def _score_sql() -> str:
    pen = " + ".join(f"(count(*) - count({c})) * 100.0 / count(*)" for c in L_CURVES)
    return sql(f"SELECT well_api, {R(f'greatest(0.0, 100.0 - ({pen}) / 6.0)')} AS quality_score FROM l GROUP BY well_api")


@register("quality_score", _score_sql())
def quality_score(spark, sf):
    return round_doubles(Q.quality_score(L(spark, sf), L_CURVES))


def _clip_sql() -> str:
    def c(x, lo, hi):
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END"
    return sql("SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R(c("GR", 10.0, 250.0)) + " AS GR, "
               + R(c("RHOB", 1.5, 3.0)) + " AS RHOB, " + R(c("NPHI", 0.0, 60.0)) + " AS NPHI, "
               + R("RT") + " AS RT, " + R(c("PE", 0.0, 10.0)) + " AS PE FROM l")


@register("clip_ranges", _clip_sql())
def clip_ranges_q(spark, sf):
    return round_doubles(clip_ranges(L(spark, sf)).drop("operator_id"))


DEPTH_STEPS_SQL = sql(""",
s AS (SELECT well_api, src_row, DEPTH,
             DEPTH - lag(DEPTH) OVER (PARTITION BY well_api ORDER BY src_row) AS step,
             row_number() OVER (PARTITION BY well_api ORDER BY src_row) AS rn FROM e),
a AS (SELECT well_api, count(*) AS n_records, arg_min(DEPTH, src_row) AS first_depth,
             arg_max(DEPTH, src_row) AS last_depth, min(DEPTH) AS min_depth, max(DEPTH) AS max_depth,
             max(CASE WHEN rn = 2 THEN step END) AS first_step,
             count(*) FILTER (WHERE step < 0) AS n_reversals, min(step) AS min_step, max(step) AS max_step,
             median(step) AS median_step
      FROM s GROUP BY well_api)
SELECT well_api, n_records, """ + ", ".join(f"{R(c)} AS {c}" for c in [
    "first_depth", "last_depth", "min_depth", "max_depth", "first_step"]) + """, n_reversals,
       """ + R("min_step") + " AS min_step, " + R("max_step") + " AS max_step, " + R("median_step") + """ AS median_step,
       CASE WHEN last_depth > first_depth THEN 'increasing' WHEN last_depth < first_depth THEN 'decreasing'
            ELSE 'flat' END AS direction
FROM a""")


@register("depth_steps", DEPTH_STEPS_SQL)
def depth_steps(spark, sf):
    return round_doubles(Q.depth_step_report(E(spark, sf)))


@register("completeness_by_well", sql(
    "SELECT well_api, curve, " + R("pct") + " AS completeness_pct FROM ("
    + " UNION ALL ".join(f"SELECT well_api, '{c}' AS curve, avg(CAST({c} IS NOT NULL AS DOUBLE)) * 100 AS pct FROM l GROUP BY well_api" for c in L_CURVES)
    + ")"))
def completeness_by_well(spark, sf):
    return round_doubles(Q.completeness(L(spark, sf), L_CURVES))


QC_REPORT_SQL = f"""
WITH t AS ({ORACLES["qc_target_stats"]}),
m AS ({ORACLES["mad_outliers"]}),
n AS ({ORACLES["null_sentinel_pct"]}),
d AS ({ORACLES["depth_steps"]}),
raw AS ({sql("SELECT well_api, (count(*) - count(GR)) * 100.0 / count(*) AS pct FROM e GROUP BY well_api")})
SELECT t.well_api, n_rows, gr_min, gr_max, gr_mean, gr_std, gr_completeness, n_outliers AS gr_outliers_mad,
       {R("greatest(0.0, 100.0 - pct / 2.0)")} AS quality_score, n_reversals,
       concat_ws('; ',
         CASE WHEN n_reversals > 0 THEN printf('Depth reversals detected: %d', n_reversals) END,
         CASE WHEN n.flagged THEN printf('GR: %.1f%% missing', floor(pct * 10 + 0.5) / 10) END,
         CASE WHEN below_min > 0 THEN printf('GR below 10.0: %d values', below_min) END,
         CASE WHEN above_max > 0 THEN printf('GR above 250.0: %d values', above_max) END,
         CASE WHEN m.flagged THEN printf('Statistical outliers: %d values', n_outliers) END) AS flags
FROM t LEFT JOIN m USING (well_api) JOIN n USING (well_api) JOIN d USING (well_api) JOIN raw USING (well_api)
"""


@register("qc_report", QC_REPORT_SQL)
def qc_report(spark, sf):
    """Per-well QC report with its flags in the report's order, joined to one text."""
    out = Q.qc_report(E(spark, sf).select("well_api", "src_row", "DEPTH", "GR"), "GR", ["GR"])
    return round_doubles(out.withColumn("flags", F.array_join("flags", "; ")))
