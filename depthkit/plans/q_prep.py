"""Registered preprocessing queries (J1, W11-W14, A8, A9) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.operators import impute as IM
from depthkit.operators import resample as RS
from depthkit.plans.common import E, L, L_CURVES, R, register, round_doubles, sql

W = "PARTITION BY well_api ORDER BY DEPTH"

RESAMPLE_SQL = sql(""",
st AS (SELECT well_api, min(DEPTH) AS mn, max(DEPTH) AS mx,
              CAST(floor((max(DEPTH) - min(DEPTH)) / 1.0) AS BIGINT) + 1 AS n
       FROM e GROUP BY well_api),
gi AS (SELECT well_api, mn, mx, n, unnest(range(0, n)) AS i FROM st),
g AS (SELECT well_api, CASE WHEN n = 1 THEN mn WHEN i = n - 1 THEN mx
                            ELSE i * ((mx - mn) / (n - 1)) + mn END AS d FROM gi),
s AS (SELECT well_api, DEPTH, GR FROM (
        SELECT well_api, DEPTH, GR, row_number() OVER (PARTITION BY well_api, DEPTH ORDER BY src_row) AS k
        FROM e WHERE GR IS NOT NULL) WHERE k = 1),
c AS (SELECT well_api, count(*) AS cnt FROM s GROUP BY well_api),
a AS (SELECT g.well_api, g.d, p.DEPTH AS pd, p.GR AS pv FROM g ASOF LEFT JOIN s p
        ON g.well_api = p.well_api AND g.d >= p.DEPTH),
b AS (SELECT a.*, nx.DEPTH AS nd, nx.GR AS nv FROM a ASOF LEFT JOIN s nx
        ON a.well_api = nx.well_api AND a.d <= nx.DEPTH)
SELECT b.well_api, """ + R("d") + " AS DEPTH, " + R("""CASE WHEN coalesce(cnt, 0) < 2 THEN NULL WHEN pd IS NULL THEN NULL
            WHEN pd = d THEN pv WHEN nd IS NULL THEN NULL
            ELSE (nv - pv) / (nd - pd) * (d - pd) + pv END""") + """ AS GR
FROM b LEFT JOIN c ON b.well_api = c.well_api""")


@register("resample_grid", RESAMPLE_SQL)
def resample_grid(spark, sf):
    df = E(spark, sf).select("well_api", "src_row", "DEPTH", "GR")
    return round_doubles(RS.resample(df, ["GR"], step=1.0))


@register("dedupe_depth", sql(""",
f AS (SELECT well_api, src_row, CAST(floor(DEPTH) AS DOUBLE) AS DEPTH, GR FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY well_api, DEPTH ORDER BY src_row) AS k FROM f)
SELECT well_api, src_row, DEPTH, """ + R("GR") + " AS GR FROM r WHERE k = 1"))
def dedupe_depth(spark, sf):
    df = E(spark, sf).select("well_api", "src_row", F.floor("DEPTH").cast("double").alias("DEPTH"), "GR")
    return round_doubles(RS.dedupe_depth(df))


@register("fill_forward_backward", sql(
    "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + R("GR") + " AS GR, "
    + R(f"last_value(GR IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") + " AS GR_ffill, "
    + R(f"first_value(GR IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)") + " AS GR_bfill FROM e"))
def fill_forward_backward(spark, sf):
    df = E(spark, sf).select("well_api", "DEPTH", "GR")
    return round_doubles(IM.fill_forward_backward(df, ["GR"]))


def _interp_sql(c: str) -> dict[str, str]:
    up = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    on = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return {
        f"pi_{c}": f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {up}",
        f"pv_{c}": f"last_value({c} IGNORE NULLS) {up}",
        f"ni_{c}": f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {on}",
        f"nv_{c}": f"first_value({c} IGNORE NULLS) {on}",
    }


def _interp_value(c: str) -> str:
    return (f"coalesce({c}, CASE WHEN pi_{c} IS NOT NULL AND ni_{c} IS NOT NULL THEN "
            f"(nv_{c} - pv_{c}) / (ni_{c} - pi_{c}) * (pos - pi_{c}) + pv_{c} END, pv_{c}, nv_{c})")


@register("interpolate_index", sql(f""",
p AS (SELECT well_api, DEPTH, GR, row_number() OVER ({W}) AS pos FROM e),
q AS (SELECT *, """ + ", ".join(f"{v} AS {k}" for k, v in _interp_sql("GR").items()) + """ FROM p)
SELECT well_api, """ + R("DEPTH") + " AS DEPTH, " + R(_interp_value("GR")) + " AS GR FROM q"))
def interpolate_index(spark, sf):
    df = E(spark, sf).select("well_api", "DEPTH", "GR")
    return round_doubles(IM.interpolate_index(df, ["GR"]))


#: Curves that are NULL in the same rows, so that rows without any usable neighbour occur.
SHARED = {"RHOB": "GR", "PE": "GR"}


def _impute_sql(threshold: float = 20.0, shared: dict[str, str] | None = None, cs: list[str] | None = None) -> str:
    """The policy step by step on the rows: one set of CTEs per curve, each reading the last one's result."""
    cs = cs or L_CURVES
    src = ", ".join(f"CASE WHEN {shared[c]} IS NULL THEN NULL ELSE {c} END AS {c}" if shared and c in shared else c for c in cs)
    parts = [f"src AS (SELECT well_api, DEPTH, {src} FROM l)",
             "m AS (SELECT well_api, " + ", ".join(f"median({c}) AS med_{c}" for c in cs) + " FROM src GROUP BY well_api)",
             f"t0 AS (SELECT *, row_number() OVER ({W}) AS pos FROM src)"]
    for i, c in enumerate(cs):
        others = [e for e in cs if e != c]
        av = ", ".join(f"count({e}) OVER p > count(*) OVER p * 0.5 AS av_{e}" for e in others)
        near = ", ".join(f"{v} AS {k}" for k, v in _interp_sql(c).items())
        usable = " OR ".join([f"{c} IS NOT NULL", *(f"(av_{e} AND {e} IS NOT NULL)" for e in others)])
        parts += [
            f"a{i} AS (SELECT *, (count(*) OVER p - count({c}) OVER p) * 100.0 / count(*) OVER p AS pct, {av}, {near} "
            f"FROM t{i} WINDOW p AS (PARTITION BY well_api))",
            f"b{i} AS (SELECT *, ({usable}) AS usable, ({' OR '.join(f'av_{e}' for e in others)}) AS any_av FROM a{i})",
            f"d{i} AS (SELECT *, count(*) FILTER (WHERE usable) OVER (PARTITION BY well_api) AS nuse FROM b{i})",
            f"t{i + 1} AS (SELECT well_api, DEPTH, pos, {', '.join(others)}, CASE WHEN pct = 0 THEN {c} WHEN pct < 5 THEN {_interp_value(c)} "
            f"WHEN pct < {threshold} AND any_av AND nuse > 10 AND NOT usable THEN NULL ELSE coalesce({c}, med_{c}) END AS {c} "
            f"FROM d{i} JOIN m USING (well_api))"]
    return sql(", " + ", ".join(parts) + " SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + ", ".join(f"{R(c)} AS {c}" for c in cs) + f" FROM t{len(cs)}")


@register("impute_shared_nulls", _impute_sql(shared=SHARED))
def impute_shared_nulls(spark, sf):
    df = L(spark, sf).drop("operator_id")
    df = df.withColumns({c: F.when(F.col(by).isNotNull(), F.col(c)) for c, by in SHARED.items()})
    return round_doubles(IM.impute_policy(df, L_CURVES))


@register("impute_policy", _impute_sql())
def impute_policy(spark, sf):
    df = L(spark, sf).drop("operator_id")
    return round_doubles(IM.impute_policy(df, L_CURVES))


@register("impute_median", sql(
    ", m AS (SELECT well_api, " + ", ".join(f"median({c}) AS m_{c}" for c in L_CURVES) + " FROM l GROUP BY well_api) "
    "SELECT well_api, " + R("DEPTH") + " AS DEPTH, " + ", ".join(f"{R(f'coalesce({c}, m_{c})')} AS {c}" for c in L_CURVES)
    + " FROM l JOIN m USING (well_api)"))
def impute_median(spark, sf):
    df = L(spark, sf).drop("operator_id")
    return round_doubles(IM.impute_median(df, L_CURVES))


@register("quality_flags", sql(
    "SELECT well_api, curve, 'high_missing' AS issue, " + R("pct") + " AS percentage FROM ("
    + " UNION ALL ".join(f"SELECT well_api, '{c}' AS curve, (count(*) - count({c})) * 100.0 / count(*) AS pct FROM l GROUP BY well_api" for c in L_CURVES)
    + ") WHERE pct >= 20"))
def quality_flags(spark, sf):
    df = L(spark, sf).drop("operator_id")
    plan = IM.imputation_plan(df, L_CURVES)
    return round_doubles(IM.missing_flags(plan, L_CURVES, "well_api", S.IMPUTATION_THRESHOLD))
