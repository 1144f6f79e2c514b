"""Registered twins of the series queries on a hard log: one well with a third of the rows, null wells,
null and tied depths, and wells without any value.  Blocks are small, so that every carry is used."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit.operators import explore as EX
from depthkit.operators import impute as IM
from depthkit.operators import quality as QU
from depthkit.operators import resample as RS
from depthkit.plans.common import R, register, round_doubles, sql
from depthkit.plans.q_features import HOT_SQL, hot_well_df

BLOCK = 64
W = "PARTITION BY well_api ORDER BY DEPTH NULLS FIRST, src_row"
UP = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ON = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
CTE = HOT_SQL + ", h AS (SELECT well_api, src_row, DEPTH, CASE WHEN well_api % 5 = 1 THEN NULL ELSE GR END AS GR FROM hot)"
#: Nearest valid rows of GR with their position, depth and value.
NEAR = CTE + f""",
o AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM h),
t AS (SELECT *, last_value(CASE WHEN GR IS NOT NULL THEN {{'i': pos, 'd': DEPTH, 'v': GR}} END IGNORE NULLS) {UP} AS p,
             first_value(CASE WHEN GR IS NOT NULL THEN {{'i': pos, 'd': DEPTH, 'v': GR}} END IGNORE NULLS) {ON} AS n FROM o)
"""
INTERP = "coalesce({x}, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN (n.v - p.v) / nullif(n.i - p.i, 0) * (pos - p.i) + p.v END, p.v, n.v)"


def hard_log(spark, sf):
    df = hot_well_df(spark, sf)
    return df.withColumn("GR", F.when(F.coalesce(F.col("well_api") % 5 != 1, F.lit(True)), F.col("GR")))


def rows(expr: dict[str, str], source: str) -> str:
    return "SELECT well_api, src_row, " + R("DEPTH") + " AS DEPTH, " + ", ".join(f"{v} AS {k}" for k, v in expr.items()) + " FROM " + source


@register("fill_forward_backward_hot", sql(NEAR + rows({"GR": R("GR"), "GR_ffill": R("p.v"), "GR_bfill": R("n.v")}, "t")))
def fill_forward_backward_hot(spark, sf):
    return round_doubles(IM.fill_forward_backward(hard_log(spark, sf), ["GR"], tie="src_row", block_rows=BLOCK))


@register("interpolate_index_hot", sql(NEAR + rows({"GR": R(INTERP.format(x="GR"))}, "t")))
def interpolate_index_hot(spark, sf):
    return round_doubles(IM.interpolate_index(hard_log(spark, sf), ["GR"], tie="src_row", block_rows=BLOCK))


@register("gap_runs_hot", sql(NEAR + f"SELECT well_api, {R('min(DEPTH)')} AS start_depth, {R('max(DEPTH)')} AS end_depth, count(*) AS n_rows, "
                              f"{R('any_value(n.d) - any_value(p.d)')} AS gap_length FROM t WHERE GR IS NULL GROUP BY well_api, p.i"))
def gap_runs_hot(spark, sf):
    return round_doubles(EX.gap_runs(hard_log(spark, sf), "GR", tie="src_row", block_rows=BLOCK))


@register("gap_policy_hot", sql(NEAR + rows({
    "GR": R("GR"),
    "GR_filled": R("CASE WHEN GR IS NOT NULL THEN GR WHEN n.d - p.d < 10.0 THEN coalesce((n.v - p.v) / nullif(n.d - p.d, 0), 0) * (DEPTH - p.d) + p.v END"),
    "do_not_train": "GR IS NULL AND (p IS NULL OR n IS NULL OR coalesce(n.d - p.d > 100.0, NULL))"}, "t")))
def gap_policy_hot(spark, sf):
    return round_doubles(EX.gap_policy(hard_log(spark, sf), "GR", tie="src_row", block_rows=BLOCK))


@register("resample_grid_hot", sql(CTE + """,
k AS (SELECT coalesce(well_api, -1) AS w, src_row, DEPTH, GR FROM h WHERE DEPTH IS NOT NULL),
st AS (SELECT w, min(DEPTH) AS mn, max(DEPTH) AS mx, CAST(floor((max(DEPTH) - min(DEPTH)) / 0.5) AS BIGINT) + 1 AS n FROM k GROUP BY w),
gi AS (SELECT w, mn, mx, n, unnest(range(0, n)) AS i FROM st),
g AS (SELECT w, CASE WHEN n = 1 THEN mn WHEN i = n - 1 THEN mx ELSE i * ((mx - mn) / (n - 1)) + mn END AS d FROM gi),
s AS (SELECT w, DEPTH, arg_min(GR, src_row) AS GR FROM k WHERE GR IS NOT NULL GROUP BY w, DEPTH),
c AS (SELECT w, count(*) AS cnt FROM s GROUP BY w),
a AS (SELECT g.w, g.d, p.DEPTH AS pd, p.GR AS pv FROM g ASOF LEFT JOIN s p ON g.w = p.w AND g.d >= p.DEPTH),
b AS (SELECT a.*, x.DEPTH AS nd, x.GR AS nv FROM a ASOF LEFT JOIN s x ON a.w = x.w AND a.d <= x.DEPTH)
SELECT nullif(b.w, -1) AS well_api, """ + R("d") + " AS DEPTH, " + R("""CASE WHEN coalesce(cnt, 0) < 2 OR pd IS NULL THEN NULL WHEN pd = d THEN pv
  WHEN nd IS NULL THEN NULL ELSE (nv - pv) / (nd - pd) * (d - pd) + pv END""") + " AS GR FROM b LEFT JOIN c ON b.w = c.w"))
def resample_grid_hot(spark, sf):
    return round_doubles(RS.resample(hard_log(spark, sf), ["GR"], step=0.5, block_rows=BLOCK, grid_block=50))


FAMILY = {"GR_roll_mean_5": "GR", "GR_gradient": "GR * 2", "A_B_ratio": "GR + 1", "RT": "GR / 2"}


@register("impute_by_family_hot", sql(NEAR + ", md AS (SELECT median(GR) AS m FROM h) " + rows({
    "GR_roll_mean_5": R("coalesce(p.v, n.v, m)"), "GR_gradient": R("coalesce(2 * " + INTERP.format(x="GR") + ", 0)"),
    "A_B_ratio": R("coalesce(" + INTERP.format(x="GR") + ", m) + 1"), "RT": R("coalesce(GR, m) / 2")}, "t CROSS JOIN md")))
def impute_by_family_hot(spark, sf):
    """src_row is the order within a depth: depths are made distinct by it first, since the policy takes no tie."""
    df = hard_log(spark, sf).withColumns({k: F.expr(v) for k, v in FAMILY.items()})
    spot = df.withColumn("_at", F.coalesce(F.col("DEPTH"), F.lit(-1.0)) * 1e7 + F.col("src_row"))
    out = IM.impute_by_family(spot, list(FAMILY), order="_at", block_rows=BLOCK)
    return round_doubles(out.select("well_api", "src_row", "DEPTH", *FAMILY))


@register("mad_iqr_flags_hot", sql(CTE + f""",
q AS (SELECT well_api, quantile_cont(GR, 0.25) AS q1, median(GR) AS med, quantile_cont(GR, 0.75) AS q3 FROM h GROUP BY well_api),
m AS (SELECT h.well_api, median(abs(GR - med)) AS mad FROM h LEFT JOIN q ON h.well_api IS NOT DISTINCT FROM q.well_api GROUP BY h.well_api),
j AS (SELECT h.*, coalesce(abs(0.6745 * (GR - med) / nullif(mad, 0)) > 3.5, false) AS mad_flag,
             coalesce(GR < q1 - 1.5 * (q3 - q1) OR GR > q3 + 1.5 * (q3 - q1), false) AS iqr_flag
      FROM h LEFT JOIN q ON h.well_api IS NOT DISTINCT FROM q.well_api LEFT JOIN m ON h.well_api IS NOT DISTINCT FROM m.well_api)
SELECT well_api, src_row, {R("DEPTH")} AS DEPTH, {R("GR")} AS GR, mad_flag, iqr_flag,
       CASE WHEN NOT iqr_flag THEN NULL WHEN coalesce(lag(iqr_flag) OVER ({W}), false) OR coalesce(lead(iqr_flag) OVER ({W}), false)
            THEN 'interval' ELSE 'spike' END AS outlier_kind FROM j"""))
def mad_iqr_flags_hot(spark, sf):
    return round_doubles(EX.mad_iqr_flags(hard_log(spark, sf), "GR", tie="src_row", block_rows=BLOCK))


@register("mad_outliers_hot", sql(CTE + """,
v AS (SELECT well_api, GR FROM h WHERE GR IS NOT NULL), m AS (SELECT well_api, median(GR) AS median FROM v GROUP BY well_api),
d AS (SELECT v.well_api, median(abs(GR - median)) AS mad FROM v JOIN m ON v.well_api IS NOT DISTINCT FROM m.well_api GROUP BY v.well_api),
b AS (SELECT m.well_api, median, mad, median + 5.0 * mad AS lim FROM m JOIN d ON m.well_api IS NOT DISTINCT FROM d.well_api)
SELECT b.well_api, """ + R("median") + " AS median, " + R("mad") + " AS mad, " + R("lim") + """ AS "limit", count(*) AS n_valid, count(*) FILTER (WHERE GR > lim) AS n_outliers,
  count(*) FILTER (WHERE GR > lim) > count(*) * 0.01 AS flagged FROM b JOIN v ON b.well_api IS NOT DISTINCT FROM v.well_api GROUP BY b.well_api, median, mad, lim"""))
def mad_outliers_hot(spark, sf):
    return round_doubles(QU.mad_outliers(hard_log(spark, sf), "GR"))


@register("zscore_hot", sql(CTE + ", g AS (SELECT well_api, avg(GR) AS gm, stddev_samp(GR) AS gs FROM h GROUP BY well_api), a AS (SELECT avg(GR) AS am, stddev_samp(GR) AS s FROM h) "
                            "SELECT h.well_api, src_row, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR, " + R("(GR - gm) / nullif(gs, 0)") + " AS GR_z_well, "
                            + R("(GR - am) / nullif(s, 0)") + " AS GR_z_global FROM h LEFT JOIN g ON h.well_api IS NOT DISTINCT FROM g.well_api CROSS JOIN a"))
def zscore_hot(spark, sf):
    return round_doubles(EX.zscores(hard_log(spark, sf), "GR"))


@register("impute_median_hot", sql(CTE + ", m AS (SELECT well_api, median(GR) AS med FROM h GROUP BY well_api) SELECT h.well_api, src_row, " + R("DEPTH") + " AS DEPTH, "
                                   + R("coalesce(GR, med)") + " AS GR FROM h LEFT JOIN m ON h.well_api IS NOT DISTINCT FROM m.well_api"))
def impute_median_hot(spark, sf):
    return round_doubles(IM.impute_median(hard_log(spark, sf), ["GR"]))


@register("dedupe_depth_hot", sql(CTE + ", r AS (SELECT *, row_number() OVER (PARTITION BY well_api, DEPTH ORDER BY src_row) AS k FROM h) SELECT well_api, src_row, "
                                  + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR FROM r WHERE k = 1 OR DEPTH IS NULL"))
def dedupe_depth_hot(spark, sf):
    return round_doubles(RS.dedupe_depth(hard_log(spark, sf)))
