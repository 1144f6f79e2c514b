"""Sinks (K1-K10): tables written with the DataFrame writer.

Data tables are Parquet (optionally partitioned by group, optionally also CSV); the small
report tables (metadata, errors, flags, summaries, splits, metrics) are JSON lines.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

__all__ = ["write_table", "write_report", "write_run", "save_model"]


def write_table(df: DataFrame, path: str, partition_by: str | list[str] | None = None, csv: bool = False,
                mode: str = "overwrite") -> None:
    """K1/K4/K6/K8: a data table (master, features, scaled copies, sequences) as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    if csv:
        df.write.mode(mode).option("header", True).csv(path.rstrip("/") + "_csv")


def write_report(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """A report table as JSON lines.

    Tables that grow with wells or files (splits, errors, flags) are written by all tasks;
    ``one_file`` is for summaries of a fixed size."""
    (df.coalesce(1) if one_file else df).write.mode(mode).json(path)


def write_run(outputs: dict[str, DataFrame], root: str, data_tables: tuple[str, ...] = ("logs_master", "features"),
              partition_by: str | None = None) -> dict[str, str]:
    """Write a set of named outputs of one run under ``root``; returns name -> path."""
    paths = {}
    for name, df in outputs.items():
        p = f"{root.rstrip('/')}/{name}"
        if name in data_tables:
            write_table(df, p, partition_by)
        else:
            write_report(df, p)
        paths[name] = p
    return paths


def save_model(model: PipelineModel, path: str, metrics: DataFrame | None = None) -> None:
    """K9: Spark ML persistence for the fitted pipeline, plus its metrics table."""
    model.write().overwrite().save(path.rstrip("/") + "/model")
    if metrics is not None:
        write_report(metrics, path.rstrip("/") + "/metrics")
