"""Regular-grid resampling (J1) and duplicate-depth removal.

J1 is a two-sided as-of join expressed without a range join: grid rows are generated per
group from ``(min, max)``, in blocks of indices, and unioned with the samples; the block carry
(``carry.asof_neighbours``) finds, per grid row and curve, the nearest valid sample at or
above and at or below.  No theta join, no pairs, no series in one task, no array per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import numeric_curves
from depthkit.operators.carry import BLOCK_ROWS, asof_neighbours


#: Grid points that are made from one row.
GRID_BLOCK = 65_536


def dedupe_depth(df: DataFrame, group: str = S.GROUP, order: str = S.ORDER, file_order: str = S.SRC_ROW) -> DataFrame:
    """Keep the first row (in file order) of each (group, depth); rows without a depth all stay.

    The window is by (group, depth), and Spark keeps the first row of each before the shuffle too,
    so neither a long series nor a depth with very many rows is gathered."""
    known = df.filter(F.col(order).isNotNull())
    first = known.withColumn("_k", F.row_number().over(Window.partitionBy(group, order).orderBy(file_order))).filter("_k = 1").drop("_k")
    return first.unionByName(df.filter(F.col(order).isNull()))


def depth_grid(df: DataFrame, step: float = S.TARGET_STEP, group: str = S.GROUP, order: str = S.ORDER,
               block: int = GRID_BLOCK) -> DataFrame:
    """Grid rows (group, i, DEPTH): n = int((max-min)/step)+1 points from min to max inclusive.

    A series becomes one row per ``block`` points first, and those are dealt out before they
    become points, so a series with a far outlier is no single large array.  A series without depths has no grid."""
    st = df.groupBy(group).agg(F.min(order).alias("_mn"), F.max(order).alias("_mx")).filter(F.col("_mn").isNotNull())
    st = st.withColumn("_n", (F.floor((F.col("_mx") - F.col("_mn")) / F.lit(float(step)))).cast("long") + 1)
    last = F.col("_n") - 1
    blocks = st.select(group, "_mn", "_mx", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block).cast("long"))).alias("_b"))
    # with a number, so that adaptive execution does not put the few blocks, and all their points, in one task
    blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "_b")
    g = blocks.select(group, "_mn", "_mx", "_n", F.explode(F.sequence(F.col("_b") * block, F.least(last, (F.col("_b") + 1) * block - 1))).alias("_i"))
    d = (
        F.when(F.col("_n") == 1, F.col("_mn"))
        .when(F.col("_i") == F.col("_n") - 1, F.col("_mx"))
        .otherwise(F.col("_i") * ((F.col("_mx") - F.col("_mn")) / (F.col("_n") - 1)) + F.col("_mn"))
    )
    return g.select(group, F.col("_i").alias("grid_index"), d.alias(order))


def resample(df: DataFrame, curves: Sequence[str] | None = None, step: float = S.TARGET_STEP,
             group: str = S.GROUP, order: str = S.ORDER, file_order: str = S.SRC_ROW,
             block_rows: int = BLOCK_ROWS, grid_block: int = GRID_BLOCK) -> DataFrame:
    """Linear interpolation of every curve onto the regular grid of its group.

    Per curve: duplicate depths keep the first valid sample in file order; grid points
    outside the curve's valid span are NULL; curves with fewer than two valid samples are
    NULL throughout.  Rows without a group are a group; rows without a depth are no samples.
    """
    curves = list(curves) if curves is not None else numeric_curves(df, exclude=[file_order])
    samples = df.select(group, order, F.col(file_order).cast("long").alias("_fo"), F.lit(False).alias("_grid"), *curves)
    grid = depth_grid(df, step, group, order, grid_block).select(
        group, order, F.lit(None).cast("long").alias("_fo"), F.lit(True).alias("_grid"),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in curves])
    u = asof_neighbours(samples.filter(F.col(order).isNotNull()).unionByName(grid), curves, "_grid", "_fo", group, order, block_rows)
    d = F.col(order)
    out = [group, order]
    for c in curves:
        p, n, span = F.col(f"_prev_{c}"), F.col(f"_next_{c}"), F.col(f"_span_{c}")
        slope = F.try_divide(n["v"] - p["v"], n["d"] - p["d"])
        val = (
            F.when(span["lo"].isNull() | (span["lo"] == span["hi"]) | p.isNull(), F.lit(None).cast("double"))
            .when(p["d"] == d, p["v"])
            .when(n.isNull(), F.lit(None).cast("double"))
            .otherwise(slope * (d - p["d"]) + p["v"])
        )
        out.append(val.alias(c))
    return u.select(*out)
