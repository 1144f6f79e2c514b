"""Session helpers.

The library never creates folders of its own on a cluster: anything that must outlive a
stage (checkpoints, written intermediate tables) goes under ``spark.checkpoint.dir``, which
the cluster names.  Only when that setting is missing (local tests) do we pick a default.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "depthkit", master: str | None = None, partitions: int | None = None,
              driver_memory: str | None = None) -> SparkSession:
    """Session with UI off, UTC, AQE and skew-join handling.  ``driver_memory`` only matters
    for local mode (there the driver JVM is the executor) and must be set before start."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # else Spark 4.1 rejects spark.conf.set("spark.checkpoint.dir", ...), the setting that checkpoint_dir reads
        .config("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting.

    A local session without one gets a folder of its own under the system's temp folder.  On a
    cluster the setting is required: a folder that only the driver has would lose rows."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="depthkit-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Scratch folders of this process.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables.

    It is there until ``delete_scratch``, at the latest until the driver's Python ends: results are
    lazy, so a table may be read long after the call that wrote it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def delete_scratch(spark: SparkSession | None = None) -> None:
    """Delete the scratch folders that this process has made; frames that read them end with it."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        delete_scratch()


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialize ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint (files on shared storage survive executor
    loss; never ``localCheckpoint``) but computes the plan once, stores it columnar, and
    lets later scans prune columns and push filters."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


__all__ = ["get_spark", "checkpoint_dir", "scratch_path", "delete_scratch", "cut_lineage"]
