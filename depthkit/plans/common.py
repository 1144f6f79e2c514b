"""Shared pieces of the registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from depthkit import schema as S
from depthkit.functions.exprs import r6
from depthkit.operators.quality import apply_sentinels
from depthkit.sources.views import EVENTS_LOG_SQL, LINEITEM_LOG_SQL, events_log, lineitem_log

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 decimals, identically to ``R(...)`` in the oracles."""
    return df.select(*[
        r6(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def R(expr: str) -> str:
    """SQL twin of ``r6``."""
    x = f"CAST(({expr}) AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < 1e9 THEN floor(floor({x} * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6 "
            f"WHEN abs({x}) < 9e18 THEN floor({x} + 0.5) ELSE {x} END)")


def E(spark: SparkSession, sf: str) -> DataFrame:
    """Events log with sentinels turned into NULLs."""
    return apply_sentinels(events_log(spark, sf), ["GR"])


def L(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem_log(spark, sf)


L_CURVES = ["GR", "RHOB", "NPHI", "RT", "PE"]

CTE = f"""
WITH e_raw AS ({EVENTS_LOG_SQL}),
e AS (SELECT well_api, operator, src_row, DEPTH,
             CASE WHEN GR IN (-999.25, -9999.0, -999.0) OR isnan(GR) THEN NULL ELSE GR END AS GR
      FROM e_raw),
l AS ({LINEITEM_LOG_SQL})
"""


def sql(body: str) -> str:
    return CTE + body


__all__ = ["REGISTRY", "ORACLES", "register", "round_doubles", "R", "E", "L", "L_CURVES", "sql", "S"]
