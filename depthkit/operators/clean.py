"""Range clipping, winsorizing and two-sided outlier flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import clip
from depthkit.functions.quantiles import group_quantiles
from depthkit.operators.blocked import join_null_safe


def clip_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] = S.CLIP_RANGES) -> DataFrame:
    """Clip each listed curve that exists to its physical range, NULLs stay NULL."""
    return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns})


def winsorize(df: DataFrame, curves: Sequence[str], lower: float = 0.01, upper: float = 0.99,
              group: str | None = None) -> DataFrame:
    """Clip each curve at its own (group's) lower/upper exact percentiles."""
    keys = [group] if group else []
    out = df
    for c in curves:
        b = group_quantiles(df, keys, c, [lower, upper], [f"_lo_{c}", f"_hi_{c}"])
        out = out.crossJoin(F.broadcast(b)) if not keys else join_null_safe(out, b, keys, "left")
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))))
        out = out.drop(f"_lo_{c}", f"_hi_{c}")
    return out
