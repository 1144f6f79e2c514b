"""Runs: the tables of one run, committed by a manifest row, found again and read back.

A run writes its tables under ``<root>/<run>/``.  Only when all are written, one row is
appended to ``<root>/_manifest``: Spark's committer makes that atomic, so a run that died halfway
has no row and no reader takes it.  The row holds the run's tables, their rows, times and failures.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.sinks.writers import write_table

MANIFEST = ("run string, kind string, started double, finished double, duration_s double, n_failures long, "
            "tables array<struct<name:string, path:string, rows:long, columns:array<string>, seconds:double>>")


def write_run(spark: SparkSession, root: str, outputs: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], kind: str = "features", run: str | None = None,
              failures: DataFrame | None = None, partition_by: dict[str, str] | None = None, commit: bool = True) -> str:
    """Write the tables of a run as Parquet and commit it; returns its name.

    A table may be given as a function of the tables written before it, so that it is made from what was written.
    ``failures`` (any table, such as the files that could not be read) is written as a table of the run, too, and its
    rows are counted in the manifest.  Without ``commit`` the run stays invisible, like one that died."""
    run = run or f"run-{time.strftime('%Y%m%d-%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    base, started, tables, written = f"{root.rstrip('/')}/{run}", time.time(), [], {}
    outputs = dict(outputs) | ({"failures": failures} if failures is not None else {})
    for name, df in outputs.items():
        at = time.time()
        df = df(written) if callable(df) else df
        write_table(df, f"{base}/{name}", (partition_by or {}).get(name), mode="errorifexists")
        written[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}")
        rows = written[name].count()  # from the footers
        tables.append((name, f"{base}/{name}", rows, df.columns, time.time() - at))
    if commit:
        done, failed = time.time(), next((t[2] for t in tables if t[0] == "failures"), 0)
        row = spark.createDataFrame([(run, kind, started, done, done - started, failed, tables)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/_manifest")
    return run


def runs(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """The manifest: a row per complete run; a root without any has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    found = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/_manifest")
    return found.filter(F.col("kind") == kind) if kind else found


def newest(spark: SparkSession, root: str, kind: str | None = None) -> dict | None:
    """Manifest row of the newest complete run (ties by name); None without one."""
    rows = runs(spark, root, kind).orderBy(F.desc("finished"), F.desc("run")).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None


def load_run(spark: SparkSession, root: str, tables: Sequence[str] | None = None, kind: str | None = None, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest complete run, or of ``run``; fails if there is none or a table is missing."""
    row = newest(spark, root, kind) if run is None else next(iter(r.asDict(recursive=True) for r in runs(spark, root, kind).filter(F.col("run") == run).collect()), None)
    if row is None:
        raise ValueError(f"no complete run under {root}")
    paths = {t["name"]: t["path"] for t in row["tables"]}
    missing = [t for t in tables or [] if t not in paths]
    if missing:
        raise ValueError(f"run {row['run']} has no tables {missing}")
    return {t: spark.read.parquet(paths[t]) for t in (tables or paths)}


def load_features(spark: SparkSession, root: str, target: str = S.TARGET, group: str = S.GROUP, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, splits) of the newest complete run; fails without the target, the group or a split table that covers wells."""
    got = load_run(spark, root, ["features", "splits"], kind)
    features, splits = got["features"], got["splits"]
    for name, df, need in (("features", features, [group, target]), ("splits", splits, [group, "split"])):
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
    if not features.select(group).join(splits.select(group), group, "left_semi").head(1):
        raise ValueError("the splits name none of the features' wells")
    return features, splits


def run_report(spark: SparkSession, root: str) -> DataFrame:
    """(run, kind, table, rows, n_columns, n_failures, duration_s, is_newest), a row per table of each complete run."""
    rows = runs(spark, root)
    best = rows.groupBy().agg(F.max_by("run", F.struct("finished", "run")).alias("_best"))
    cells = rows.select("run", "kind", "n_failures", "duration_s", F.explode("tables").alias("t")).crossJoin(F.broadcast(best))
    return cells.select("run", "kind", F.col("t.name").alias("table"), F.col("t.rows").alias("rows"), F.size("t.columns").cast("long").alias("n_columns"), "n_failures", "duration_s",
                        (F.col("run") == F.col("_best")).alias("is_newest"))
