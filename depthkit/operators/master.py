"""Master table assembly and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthkit import schema as S

IDS = ["well_api", "well_name", "operator", "filename"]


def canonical_order(df: DataFrame, order: str = S.ORDER) -> DataFrame:
    """Depth, the id columns, then the curves sorted by name."""
    ids = [c for c in IDS if c in df.columns]
    rest = sorted(c for c in df.columns if c not in ids and c != order)
    return df.select(order, *ids, *rest)


def attach_ids(df: DataFrame, well_api: str | F.Column, well_name=None, operator=None, filename=None) -> DataFrame:
    """P5: add the four id columns (string) from expressions or literals."""
    def lit(x):
        if x is None:
            return F.lit(None).cast("string")
        return (x if isinstance(x, F.Column) else F.lit(x)).cast("string")
    return df.withColumns({"well_api": lit(well_api), "well_name": lit(well_name), "operator": lit(operator),
                           "filename": lit(filename)})


def union_logs(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; curves missing in a frame become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return canonical_order(out)


def run_summary(master: DataFrame, files_found: int | None = None, files_failed: int = 0) -> DataFrame:
    """A7 + U3: files, rows, distinct wells, sorted operator and curve lists, success %."""
    curves = sorted(c for c in master.columns if c not in IDS and c != S.ORDER)
    agg = master.agg(
        F.countDistinct("filename").alias("files_processed"),
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("well_api").alias("wells"),
        F.array_join(F.array_sort(F.collect_set("operator")), ",").alias("operators"),
    )
    found = F.lit(files_found) if files_found is not None else F.col("files_processed") + files_failed
    return agg.select(
        found.cast("long").alias("files_found"), "files_processed", F.lit(files_failed).cast("long").alias("files_failed"),
        (F.col("files_processed") * 100.0 / found).alias("success_pct"), "total_rows", "wells", "operators",
        F.lit(",".join(curves)).alias("curves"))


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """U4: columns added by a step, in output order."""
    old = set(before.columns)
    return [c for c in after.columns if c not in old]


# Name parts of the families in the feature summary.  Families overlap.
FEATURE_FAMILIES = {
    "rolling": ["_roll_"],
    "gradient": ["gradient", "diff_", "curvature"],
    "depth": ["depth_"],
    "geological": ["is_", "gr_"],
    "cross_curve": ["_ratio", "_diff", "_product"],
}


def feature_summary(spark: SparkSession, columns: Sequence[str], df: DataFrame | None = None) -> DataFrame:
    """(family, features) counts of the columns per family, and with ``df`` the values they hold (``valid``)."""
    rows = [(c, fam) for c in columns for fam, keys in FEATURE_FAMILIES.items() if any(k in c for k in keys)]
    named = spark.createDataFrame(rows, "feature string, family string")
    if df is None:
        return named.groupBy("family").agg(F.count(F.lit(1)).alias("features"))
    used = sorted({c for c, _ in rows})
    wide = df.agg(*[F.count(c).alias(c) for c in used])
    values = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in used])).alias("_s")).select("_s.*")
    return named.join(values, "feature").groupBy("family").agg(F.count(F.lit(1)).alias("features"), F.sum("v").alias("valid"))


def load_checks(df: DataFrame, required: Sequence[str] = ("DEPTH", "well_api", "GR"), group: str = S.GROUP) -> DataFrame:
    """Fail on missing required columns or an empty table; report rows and distinct groups."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if df.limit(1).count() == 0:
        raise ValueError("empty table")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("wells"))


def latest_run(runs: DataFrame, run: str = "run", ts: str = "ts") -> str | None:
    """The newest run name from a (run, ts) table."""
    r = runs.agg(F.max_by(run, ts).alias("r")).first()
    return r["r"] if r else None
