"""Adapter views that present the driver's Parquet tables as depth-series logs.

* ``events_log`` (E): one irregular single-curve log per ``user_id``; depth is derived from
  the event time, and two null sentinels are injected so the QC paths fire.
* ``lineitem_log`` (L): one regular five-curve log per supplier, depth step 1.

Each view has a DuckDB twin (``EVENTS_LOG_SQL`` / ``LINEITEM_LOG_SQL``) used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    depth = F.lit(4000.0) + F.expr(
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
    ) / F.lit(3.6e9)
    gr = (
        F.when(F.col("event_id") % 29 == 0, F.lit(-999.25))
        .when(F.col("event_id") % 31 == 0, F.lit(-9999.0))
        .otherwise(F.col("value"))
    )
    return ev.select(
        F.col("user_id").alias("well_api"),
        F.concat(F.lit("OP"), (F.col("user_id") % 7).cast("string")).alias("operator"),
        F.col("event_id").alias("src_row"),
        depth.alias("DEPTH"),
        gr.alias("GR"),
    )


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = li.join(su, li.l_suppkey == su.s_suppkey).join(pa, li.l_partkey == pa.p_partkey)
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return j.select(
        F.col("l_suppkey").alias("well_api"),
        F.col("s_nationkey").alias("operator_id"),
        (F.lit(7999) + F.row_number().over(w)).cast("double").alias("DEPTH"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, F.lit(None))
        .otherwise(F.col("l_quantity") * 5).cast("double").alias("GR"),
        (F.lit(1.5) + F.col("l_discount") * 10).alias("RHOB"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit(None)).otherwise(F.col("l_tax") * 500).cast("double").alias("NPHI"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_extendedprice") / 1000).cast("double").alias("RT"),
        (F.col("p_size").cast("double") / 5).alias("PE"),
    )


EVENTS_LOG_SQL = """
SELECT user_id AS well_api, 'OP' || CAST(user_id % 7 AS VARCHAR) AS operator, event_id AS src_row,
       4000 + date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3.6e9 AS DEPTH,
       CASE WHEN event_id % 29 = 0 THEN -999.25::DOUBLE
            WHEN event_id % 31 = 0 THEN -9999.0::DOUBLE ELSE value END AS GR
FROM events
"""

LINEITEM_LOG_SQL = """
SELECT l_suppkey AS well_api, s_nationkey AS operator_id,
       CAST(7999 + row_number() OVER (PARTITION BY l_suppkey
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS DOUBLE) AS DEPTH,
       CAST(CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_quantity * 5 END AS DOUBLE) AS GR,
       1.5 + l_discount * 10 AS RHOB,
       CAST(CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_tax * 500 END AS DOUBLE) AS NPHI,
       CAST(CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice / 1000 END AS DOUBLE) AS RT,
       CAST(p_size AS DOUBLE) / 5 AS PE
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""
