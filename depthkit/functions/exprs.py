"""Column-expression helpers (JVM-side built-ins only, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from depthkit import schema as S

__all__ = [
    "col", "series_window", "full_frame", "sentinel_to_null", "clip", "safe_div", "r6",
    "ffill", "flag", "numeric_curves", "boxcox_expr", "md5_order",
    "first_row", "last_row",
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def series_window(group: str | Sequence[str] = S.GROUP, order: str | Sequence[str] = S.ORDER) -> WindowSpec:
    """One ordered series per group: ``partitionBy(group).orderBy(order)``."""
    return Window.partitionBy(*_list(group)).orderBy(*_list(order))


def full_frame(w: WindowSpec) -> WindowSpec:
    """Whole-partition frame on the same spec, so Spark evaluates it in the same WindowExec."""
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def sentinel_to_null(c: str | Column, sentinels: Iterable[float] = S.NULL_SENTINELS) -> Column:
    """Sentinel values and NaN become SQL NULL."""
    x = col(c)
    return F.when(x.isin(*list(sentinels)) | F.isnan(x), F.lit(None).cast("double")).otherwise(x.cast("double"))


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """Null-preserving clip (``least(greatest(NULL, lo), hi)`` would return lo)."""
    x = col(c)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL on a zero divisor (ANSI-safe)."""
    return F.try_divide(col(a), col(b))


def r6(c: str | Column) -> Column:
    """Round half-up to 6 decimals with plain IEEE arithmetic (same result in any SQL engine).

    Rounds to 9 decimals first, so values that differ between engines only in the last bits
    (summation order) become identical before the final rounding, even on exact ties."""
    x = col(c)
    x9 = F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)
    small = F.floor(x9 * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    big = F.floor(x + F.lit(0.5)).cast("double")  # Spark's floor returns BIGINT: keep it in range
    return F.when(F.abs(x) < 1e9, small).when(F.abs(x) < 9e18, big).otherwise(x.cast("double"))


def ffill(c: str | Column, w: WindowSpec) -> Column:
    """Last non-null value up to the current row."""
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def first_row(w: WindowSpec) -> Column:
    return F.lag(F.lit(1)).over(w).isNull()


def last_row(w: WindowSpec) -> Column:
    return F.lead(F.lit(1)).over(w).isNull()


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, NULL comparisons count as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def numeric_curves(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Curve columns: numeric columns that are not ids, order or excluded names."""
    skip = set(S.ID_COLUMNS) | {S.SRC_ROW} | set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal"):
            out.append(f.name)
    return out


def boxcox_expr(x: str | Column, lam: float | Column) -> Column:
    """Box-Cox forward transform; ln(x) at lambda = 0."""
    xv = col(x)
    lamc = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(lamc == 0, F.ln(xv)).otherwise((F.pow(xv, lamc) - 1) / lamc)


def md5_order(key: str | Column, seed: int) -> Column:
    """Seeded, engine-independent pseudo-random order key: md5 of '<key>:<seed>'."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")))
