"""Stateless row-level cleaning (P3, P4, P7-P14 row parts) on batch or streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from depthkit import schema as S
from depthkit.operators.clean import clip_ranges
from depthkit.operators.features import cross_curve_exprs, lithology_exprs
from depthkit.operators.quality import apply_sentinels


def clean_stream(df: DataFrame, curves: Sequence[str], ranges=S.CLIP_RANGES, derive: bool = True) -> DataFrame:
    """Sentinels -> NULL, physical clipping, and the per-row lithology / cross-curve columns."""
    out = clip_ranges(apply_sentinels(df, curves), ranges)
    if derive:
        out = out.withColumns({**lithology_exprs(out.columns), **cross_curve_exprs(out.columns)})
    return out
