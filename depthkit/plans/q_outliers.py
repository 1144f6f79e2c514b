"""Registered multivariate outlier queries (D18) and their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from depthkit.operators import iforest as IF
from depthkit.plans.common import L, L_CURVES, R, register, round_doubles, sql
from depthkit.session import scratch_path
from depthkit.sinks.writers import write_table

SEED = 42


def _mean_path(n: str) -> str:
    return f"(CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END)"


def _forest_sql() -> str:
    """The same trees, grown level by level on the sampled rows, then walked by every row."""
    cols, k, depth = ", ".join(L_CURVES), len(L_CURVES), math.ceil(math.log2(IF.SAMPLE))
    value = "CASE c " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(L_CURVES)) + " END"
    parts = [
        f"smp AS MATERIALIZED (SELECT md5(CAST(well_api AS VARCHAR) || '|' || CAST(CAST(DEPTH AS BIGINT) AS VARCHAR) || '|:{SEED}') AS h, {cols} FROM l ORDER BY h LIMIT {IF.TREES * IF.SAMPLE})",
        f"g0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1) % {IF.TREES} AS tree, 1::BIGINT AS node, {cols} FROM smp)"]
    for lv in range(depth + 1):
        parts += [
            f"d{lv} AS (SELECT *, (((tree * 512 + node) * 48271 + {SEED}) % 2147483647 * 69621 + 1) % 2147483647 AS u FROM g{lv})",
            f"e{lv} AS (SELECT *, u % {k} AS c, ((u * 48271 + 7) % 2147483647) / 2147483647.0::DOUBLE AS share FROM d{lv})",
            f"n{lv} AS MATERIALIZED (SELECT tree, node, c, {lv} + {_mean_path('count(*)')} AS path, "
            + (f"CASE WHEN count(*) > 1 AND min({value}) < max({value}) THEN min({value}) + share * (max({value}) - min({value})) END" if lv < depth else "NULL::DOUBLE")
            + f" AS split FROM e{lv} GROUP BY tree, node, c, share)",
        ]
        if lv < depth:
            parts.append(f"g{lv + 1} AS MATERIALIZED (SELECT tree, 2 * node + (NOT coalesce({value} < split, false))::BIGINT AS node, {cols} "
                         f"FROM g{lv} JOIN n{lv} USING (tree, node) WHERE split IS NOT NULL)")
    parts.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{lv}" for lv in range(depth + 1)) + ")")
    parts.append(f"size AS (SELECT {_mean_path('max(n)')} AS expected, count(*) AS trees FROM (SELECT tree, count(*) AS n FROM g0 GROUP BY tree))")
    parts.append(f"w0 AS (SELECT well_api, DEPTH, {cols}, tree, 1::BIGINT AS node FROM l, (SELECT DISTINCT tree FROM g0))")
    for lv in range(depth):
        parts.append(f"w{lv + 1} AS (SELECT well_api, DEPTH, {cols}, tree, CASE WHEN split IS NULL THEN node ELSE 2 * node + (NOT coalesce({value} < split, false))::BIGINT END AS node "
                     f"FROM w{lv} LEFT JOIN nodes USING (tree, node))")
    parts.append(f"s AS (SELECT well_api, DEPTH, power(2.0, -sum(coalesce(path, floor(log2(node)))) / any_value(trees) / any_value(expected)) AS score "
                 f"FROM w{depth} LEFT JOIN nodes USING (tree, node) CROSS JOIN size GROUP BY well_api, DEPTH)")
    return sql(", " + ", ".join(parts) + f" SELECT well_api, {R('DEPTH')} AS DEPTH, {R('score')} AS isolation_score, {R('score')} >= {IF.OUTLIER} AS is_outlier FROM s")


@register("isolation_forest", _forest_sql())
def isolation_forest(spark, sf):
    """All five curves; the forest is written as a table and read back before it scores."""
    df = L(spark, sf).drop("operator_id")
    path = scratch_path(spark, "forest")
    write_table(IF.fit(df.withColumn("_d", F.col("DEPTH").cast("long")), L_CURVES, ["well_api", "_d"], seed=SEED), path)
    out = round_doubles(IF.score(df, spark.read.parquet(path), L_CURVES).select("well_api", "DEPTH", "isolation_score"))
    return out.withColumn("is_outlier", F.col("isolation_score") >= IF.OUTLIER)
