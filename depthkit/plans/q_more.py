"""Registered queries: sequences (W15), family imputation (W16), master union and run summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import series_window
from depthkit.operators import features as FE
from depthkit.operators import impute as IM
from depthkit.operators import master as MA
from depthkit.operators.sequences import sequences as make_sequences
from depthkit.plans.common import E, L, R, register, round_doubles, sql
from depthkit.plans.q_features import GRADIENT_SQL_LEVELS, _roll_sql

SEQ_LEN = S.SEQUENCE_LENGTH
SEQ_FEATS = ["RHOB", "NPHI", "RT", "PE"]


def _seq_sql() -> str:
    ok = ", ".join(f"bool_and({c} IS NOT NULL) OVER pw AS ok_{c}" for c in SEQ_FEATS)
    vec = "list_filter([" + ", ".join(f"CASE WHEN ok_{c} THEN {c} END" for c in SEQ_FEATS) + "], lambda x: x IS NOT NULL)"
    fu = "list_filter([" + ", ".join(f"CASE WHEN ok_{c} THEN '{c}' END" for c in SEQ_FEATS) + "], lambda x: x IS NOT NULL)"
    return sql(f""",
m AS (SELECT well_api, DEPTH, GR, {", ".join(SEQ_FEATS)}, {ok},
             row_number() OVER (PARTITION BY well_api ORDER BY DEPTH) - 1 AS i, count(*) OVER pw AS n
      FROM l WINDOW pw AS (PARTITION BY well_api)),
v AS (SELECT *, {vec} AS vec, {fu} AS fu FROM m),
s AS (SELECT *, list(vec) OVER (PARTITION BY well_api ORDER BY DEPTH ROWS BETWEEN {SEQ_LEN} PRECEDING AND 1 PRECEDING) AS seq FROM v),
k AS (SELECT * FROM s WHERE n >= {2 * SEQ_LEN} AND i >= {SEQ_LEN} AND i < n - {SEQ_LEN} AND GR IS NOT NULL AND len(fu) > 0)
SELECT well_api, {R("DEPTH")} AS depth,
       CAST(row_number() OVER (PARTITION BY well_api ORDER BY DEPTH) - 1 AS INTEGER) AS sequence_idx,
       {R("GR")} AS target, CAST(len(seq) AS INTEGER) AS n_steps, CAST(len(seq[1]) AS INTEGER) AS n_features,
       array_to_string(fu, ',') AS features_used,
       {R("list_sum(flatten(seq))")} AS seq_sum, {R("seq[1][1]")} AS seq_first, {R("seq[-1][-1]")} AS seq_last
FROM k""")


@register("sequences", _seq_sql())
def sequences(spark, sf):
    s = make_sequences(L(spark, sf), SEQ_FEATS, "GR", SEQ_LEN, 1)
    flat = F.flatten("sequence")
    return round_doubles(s.select(
        "well_api", "depth", "sequence_idx", "target", F.size("sequence").alias("n_steps"),
        F.size(F.col("sequence")[0]).alias("n_features"), F.array_join("features_used", ",").alias("features_used"),
        F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("seq_sum"),
        F.col("sequence")[0][0].alias("seq_first"), F.element_at(F.element_at("sequence", -1), -1).alias("seq_last")))


FAMILY_FEATS = ["GR_roll_mean_5", "GR_roll_std_5", "GR_gradient", "GR_diff_1", "GR_pct_change_1",
                "GR_RHOB_ratio", "RT_PE_ratio", "RT", "NPHI"]


def family_frame(spark, sf):
    df = L(spark, sf).select("well_api", "DEPTH", "GR", "RHOB", "NPHI", "RT", "PE")
    w = series_window()
    ro = FE.rolling_exprs("GR", w, [5], quantiles=False)
    df = FE.gradient_features(df, "GR", [1])
    df = df.withColumns({"GR_roll_mean_5": ro["GR_roll_mean_5"], "GR_roll_std_5": ro["GR_roll_std_5"],
                         "GR_RHOB_ratio": F.try_divide(F.col("GR"), F.col("RHOB") + 1e-8),
                         "RT_PE_ratio": F.try_divide(F.col("RT"), F.col("PE") + 1e-8)})
    return df.select("well_api", "DEPTH", *FAMILY_FEATS)


def _family_sql() -> str:
    W = "PARTITION BY well_api ORDER BY DEPTH"
    r5 = _roll_sql("GR", 5)
    up = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    on = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

    def interp(c):
        return (f"coalesce({c}, CASE WHEN pi_{c} IS NOT NULL AND ni_{c} IS NOT NULL THEN "
                f"(nv_{c} - pv_{c}) / (ni_{c} - pi_{c}) * (pos - pi_{c}) + pv_{c} END, pv_{c}, nv_{c})")

    def parts(c):
        return (f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {up} AS pi_{c}, "
                f"last_value({c} IGNORE NULLS) {up} AS pv_{c}, "
                f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {on} AS ni_{c}, "
                f"first_value({c} IGNORE NULLS) {on} AS nv_{c}")

    interp_cols = ["GR_gradient", "GR_diff_1", "GR_pct_change_1", "GR_RHOB_ratio", "RT_PE_ratio"]
    fill = {
        "GR_roll_mean_5": f"coalesce(GR_roll_mean_5, last_value(GR_roll_mean_5 IGNORE NULLS) {up}, first_value(GR_roll_mean_5 IGNORE NULLS) {on}, md_GR_roll_mean_5)",
        "GR_roll_std_5": f"coalesce(GR_roll_std_5, last_value(GR_roll_std_5 IGNORE NULLS) {up}, first_value(GR_roll_std_5 IGNORE NULLS) {on}, md_GR_roll_std_5)",
        "GR_gradient": f"coalesce({interp('GR_gradient')}, 0.0)",
        "GR_diff_1": f"coalesce({interp('GR_diff_1')}, 0.0)",
        "GR_pct_change_1": f"coalesce({interp('GR_pct_change_1')}, 0.0)",
        "GR_RHOB_ratio": f"coalesce({interp('GR_RHOB_ratio')}, md_GR_RHOB_ratio)",
        "RT_PE_ratio": f"coalesce({interp('RT_PE_ratio')}, md_RT_PE_ratio)",
        "RT": "coalesce(RT, md_RT)", "NPHI": "coalesce(NPHI, md_NPHI)",
    }
    return sql(f""", src AS (SELECT * FROM l), {GRADIENT_SQL_LEVELS.strip()},
f AS (SELECT well_api, DEPTH, {r5['GR_roll_mean_5']} AS GR_roll_mean_5, {r5['GR_roll_std_5']} AS GR_roll_std_5,
             GR_gradient, GR_diff_1, GR_pct_change_1, GR / nullif(RHOB + 1e-8, 0) AS GR_RHOB_ratio,
             RT / nullif(PE + 1e-8, 0) AS RT_PE_ratio, RT, NPHI FROM g3),
md AS (SELECT {", ".join(f"median({c}) AS md_{c}" for c in FAMILY_FEATS)} FROM f),
p AS (SELECT f.*, md.*, row_number() OVER ({W}) AS pos FROM f CROSS JOIN md),
q AS (SELECT *, {", ".join(parts(c) for c in interp_cols)} FROM p)
SELECT well_api, {R("DEPTH")} AS DEPTH, {", ".join(f"{R(v)} AS {k}" for k, v in fill.items())} FROM q""")


@register("impute_by_family", _family_sql())
def impute_by_family(spark, sf):
    df = family_frame(spark, sf)
    return round_doubles(IM.impute_by_family(df, FAMILY_FEATS))


def master_frame(spark, sf):
    e = E(spark, sf)
    e = MA.attach_ids(e.drop("src_row"), F.concat(F.lit("E-"), F.col("well_api").cast("string")),
                      F.concat(F.lit("user "), F.col("well_api").cast("string")), F.col("operator"), F.lit("events"))
    li = L(spark, sf)
    li = MA.attach_ids(li, F.concat(F.lit("L-"), F.col("well_api").cast("string")),
                       F.concat(F.lit("supplier "), F.col("well_api").cast("string")),
                       F.concat(F.lit("N"), F.col("operator_id").cast("string")), F.lit("lineitem")).drop("operator_id")
    return MA.union_logs([e, li])


MASTER_SQL_CTE = """,
m AS (SELECT DEPTH, 'E-' || CAST(well_api AS VARCHAR) AS well_api, 'user ' || CAST(well_api AS VARCHAR) AS well_name,
             operator, 'events' AS filename, GR FROM e
      UNION ALL BY NAME
      SELECT DEPTH, 'L-' || CAST(well_api AS VARCHAR) AS well_api, 'supplier ' || CAST(well_api AS VARCHAR) AS well_name,
             'N' || CAST(operator_id AS VARCHAR) AS operator, 'lineitem' AS filename, GR, RHOB, NPHI, RT, PE FROM l)
"""


@register("master_union", sql(MASTER_SQL_CTE + "SELECT " + R("DEPTH") + " AS DEPTH, well_api, well_name, operator, filename, "
                              + ", ".join(f"{R(c)} AS {c}" for c in ["GR", "NPHI", "PE", "RHOB", "RT"]) + " FROM m"))
def master_union(spark, sf):
    return round_doubles(master_frame(spark, sf))


@register("run_summary", sql(MASTER_SQL_CTE + """
SELECT CAST(count(DISTINCT filename) AS BIGINT) AS files_found, count(DISTINCT filename) AS files_processed,
       CAST(0 AS BIGINT) AS files_failed, """ + R("count(DISTINCT filename) * 100.0 / count(DISTINCT filename)") + """ AS success_pct,
       count(*) AS total_rows, count(DISTINCT well_api) AS wells,
       array_to_string(list_sort(list(DISTINCT operator)), ',') AS operators, 'GR,NPHI,PE,RHOB,RT' AS curves FROM m"""))
def run_summary(spark, sf):
    return round_doubles(MA.run_summary(master_frame(spark, sf)))
