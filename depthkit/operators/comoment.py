"""Co-moments of all curve pairs in one pass, and feature selection on them (D9, variance and correlation filter).

For every pair the rows that have both values count.  With absent values as 0, all sums of all pairs are
entries of four matrix products of a batch of rows, so a task adds up small matrices and emits one row per pair
and task; rows are never multiplied by pairs.  Values are shifted by their means first, which keeps the
sums accurate.  Many curves are worked on in tiles of ``TILE``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def comoments(df: DataFrame, curves: Sequence[str], tile: int = TILE) -> DataFrame:
    """(i, j, n, mx, my, cxx, cyy, cxy) for i <= j: numbers of the curves, rows with both values, means and centred sums of products."""
    curves, k = list(curves), len(curves)
    first = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"c{i}") for i, c in enumerate(curves)]).first()  # one row
    shift = np.array([float(v) if v is not None else 0.0 for v in first])
    tiles = [np.arange(a, min(a + tile, k)) for a in range(0, k, tile)]

    def run(batches):
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], 1) - shift
            has = ~np.isnan(x)
            x[~has] = 0.0
            has, sq = has.astype(float), x * x
            for a, rows in enumerate(tiles):
                for b, cols in enumerate(tiles[a:], a):
                    h, g = has[:, rows], has[:, cols]
                    part = np.stack([h.T @ g, x[:, rows].T @ g, h.T @ x[:, cols], sq[:, rows].T @ g, h.T @ sq[:, cols], x[:, rows].T @ x[:, cols]])
                    sums[a, b] = sums[a, b] + part if (a, b) in sums else part
        for (a, b), part in sums.items():
            i, j = np.meshgrid(tiles[a], tiles[b], indexing="ij")
            keep = (i <= j).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()[keep], pa.int32()), pa.array(j.ravel()[keep], pa.int32()), *[pa.array(p.ravel()[keep]) for p in part]],
                                             ["i", "j", *_SUMS])

    parts = df.select(*[F.col(c).cast("double").alias(f"c{n}") for n, c in enumerate(curves)]).mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    t = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    means = F.array(*[F.lit(float(v)) for v in shift])
    n = F.col("n")
    return t.select("i", "j", n.cast("long").alias("n"), (F.try_divide(F.col("sx"), n) + F.get(means, F.col("i"))).alias("mx"), (F.try_divide(F.col("sy"), n) + F.get(means, F.col("j"))).alias("my"),
                    (F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)).alias("cxx"), (F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)).alias("cyy"),
                    (F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)).alias("cxy"))


def _spread(c: str, mean: str) -> Column:
    """A centred sum of squares; what rounding leaves of a constant is 0."""
    return F.when(F.col(c) > F.col("n") * F.greatest(F.col(mean) * F.col(mean), F.lit(1e-300)) * 1e-14, F.col(c)).otherwise(0.0)


def pair_statistics(df: DataFrame, curves: Sequence[str], tile: int = TILE) -> DataFrame:
    """(curve_a, curve_b, n, corr, slope, intercept) of each pair a before b, over the rows that have both."""
    m = comoments(df, curves, tile).filter("i < j").withColumns({"cxx": _spread("cxx", "mx"), "cyy": _spread("cyy", "my")})
    names = F.array(*[F.lit(c) for c in curves])
    slope = F.try_divide(F.col("cxy"), F.col("cxx"))
    corr = F.try_divide(F.col("cxy"), F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy")))
    return m.select(F.get(names, F.col("i")).alias("curve_a"), F.get(names, F.col("j")).alias("curve_b"), "n", F.when(F.col("n") > 1, corr).alias("corr"),
                    slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def select_uncorrelated(df: DataFrame, features: Sequence[str], min_variance: float = 0.001, max_corr: float = 0.98, tile: int = TILE) -> DataFrame:
    """(feature, variance, kept, reason): features in the given order, each kept unless its variance (population) is at most
    ``min_variance`` or its absolute correlation with a kept one is above ``max_corr`` (``reason`` names the first such).

    The choice is made on the matrix, which has a row per pair of features whatever the number of rows."""
    features = list(features)
    cells = {(r["i"], r["j"]): r for r in comoments(df, features, tile).withColumns({"cxx": _spread("cxx", "mx"), "cyy": _spread("cyy", "my")}).collect()}
    kept, out = [], []
    for j, name in enumerate(features):
        own = cells.get((j, j))
        variance = own["cxx"] / own["n"] if own and own["n"] else None
        reason = "variance" if variance is None or variance <= min_variance else None
        for i in kept if reason is None else []:
            c = cells.get((i, j))
            if c and c["cxx"] > 0 and c["cyy"] > 0 and abs(c["cxy"]) / (c["cxx"] ** 0.5 * c["cyy"] ** 0.5) > max_corr:
                reason = features[i]
                break
        if reason is None:
            kept.append(j)
        out.append((name, variance, reason is None, reason))
    return df.sparkSession.createDataFrame(out, "feature string, variance double, kept boolean, reason string")
