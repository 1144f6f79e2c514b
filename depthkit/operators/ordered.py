"""Rolling statistics and fills of ordered rows, an Arrow batch at a time in numpy.

A window aggregate of Spark is computed anew for each row's frame, value by value; here one step handles a whole
batch.  Rows arrive as a window left them: whole series (or blocks) in a partition, in order, each first row marked.
Frames are bounded, so rolling statistics hold a frame's rows between batches; fills look arbitrarily far and hold
one series, which ``FILL_ROWS`` bounds.  Sums, moments and interpolations take the same steps in the same order as
Spark's own aggregates.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Most rows of a series that a task holds while it fills gaps.
FILL_ROWS = 1 << 17
#: Rows handled at once, if series end before.
_SLICE = 1 << 14


def fits_arrow(df: DataFrame) -> bool:
    """Whether Arrow can hold all columns."""
    try:
        to_arrow_schema(df.schema)
    except Exception:  # a type without a counterpart
        return False
    return True


def rolling_names(x: str, windows: Sequence[int], quantiles: bool) -> list[str]:
    return [f"{x}_roll_{s}_{w}" for w in windows for s in ("mean", "std", "min", "max", "range", *(("q25", "q75") if quantiles else ()))]


def _bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each row's series and of the first row after it."""
    at = np.arange(len(first))
    end = np.where(first, at, len(first))
    end = np.append(np.minimum.accumulate(end[::-1])[::-1][1:], len(first))
    return np.maximum.accumulate(np.where(first, at, 0)), end


def _shifted(a: np.ndarray, by: int, empty) -> np.ndarray:
    """``a[i + by]`` for each i, ``empty`` outside."""
    out = np.full(len(a), empty, a.dtype)
    n = len(a) - abs(by)
    if n > 0:
        out[max(-by, 0):max(-by, 0) + n] = a[max(by, 0):max(by, 0) + n]
    return out


def _values(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether not null); null is NaN among the values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def rolling(x: np.ndarray, valid: np.ndarray, first: np.ndarray, windows: Sequence[int], quantiles: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, null) of each of ``rolling_names``, over centered frames inside the series."""
    start, end = _bounds(first)
    at, out = np.arange(len(x)), []
    for win in windows:
        ahead = (win - 1) // 2
        n, total, mean, m2 = (np.zeros(len(x)) for _ in range(4))
        low, high, frame = np.full(len(x), np.nan), np.full(len(x), -np.inf), []
        for by in range(-(win - 1 - ahead), ahead + 1):
            ok = _shifted(valid, by, False) & (at + by >= start) & (at + by < end)
            v = _shifted(x, by, np.nan)
            n += ok
            total += np.where(ok, v, 0.0)
            delta = np.where(ok, v - mean, 0.0)
            part = delta / np.maximum(n, 1)
            mean += part
            m2 += delta * (delta - part)
            low = np.where(ok, np.fmin(low, v), low)
            high = np.where(ok, np.maximum(high, v), high)
            if quantiles:
                frame.append(np.where(ok, v, np.nan))
        null, k = n < max(1, win // 3), np.maximum(n, 1)
        out += [(total / k, null), (np.sqrt(m2 / np.maximum(n - 1, 1)), null | (n < 2)), (low, null), (high, null), (high - low, null)]
        if quantiles:
            frame = np.sort(np.stack(frame, 1), axis=1)  # nulls are last
            for q in (0.25, 0.75):
                place = (k - 1) * q
                lo, hi = np.floor(place), np.ceil(place)
                a, b = frame[at, lo.astype(int)], frame[at, hi.astype(int)]
                out.append((np.where((lo == hi) | (a == b), a, (hi - place) * a + (place - lo) * b), null))
    return out


def with_rolling(df: DataFrame, x: str, windows: Sequence[int], quantiles: bool, first: str) -> DataFrame:
    """``df`` with the rolling statistics of ``x``; rows are in order, whole blocks in a partition, ``first`` marks the first row of each."""
    names = rolling_names(x, windows, quantiles)
    back, ahead = max(w - 1 - (w - 1) // 2 for w in windows), max((w - 1) // 2 for w in windows)

    def run(batches):
        held, told = None, 0  # the last rows, and how many of them were returned already

        def done(table: pa.Table, lo: int, hi: int):
            values, valid = _values(table.column(x))
            with np.errstate(all="ignore"):
                cols = rolling(values, valid, table.column(first).combine_chunks().to_numpy(zero_copy_only=False), windows, quantiles)
            out = table.slice(lo, hi - lo)
            for name, (v, null) in zip(names, cols):
                out = out.append_column(name, pa.array(v[lo:hi], mask=null[lo:hi]))
            return out.combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            upto = max(told, table.num_rows - ahead)
            if upto > told:
                yield from done(table, told, upto)
            keep = max(0, upto - back)
            held, told = table.slice(keep).combine_chunks(), upto - keep
        if held is not None and held.num_rows > told:
            yield from done(held, told, held.num_rows)

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def filled(values: np.ndarray, valid: np.ndarray, start: np.ndarray, end: np.ndarray, between: bool) -> tuple[np.ndarray, np.ndarray]:
    """(values, null) with gaps filled by the value above, else below; or linearly in ``between`` (ends by the nearest)."""
    at, n = np.arange(len(values)), len(values)
    gap = np.flatnonzero(~valid)
    above = np.maximum.accumulate(np.where(valid, at, -1))[gap]
    below = np.minimum.accumulate(np.where(valid, at, n)[::-1])[::-1][gap]
    has_a, has_b = above >= start[gap], below < end[gap]
    a, b = values[np.maximum(above, 0)], values[np.minimum(below, n - 1)]
    fill = np.where(has_a, a, b)
    if between:
        slope = (b - a) / np.maximum(below - above, 1)
        fill = np.where(has_a & has_b, slope * (gap - above) + a, fill)
    out, null = values.copy(), np.zeros(n, bool)
    out[gap], null[gap] = fill, ~(has_a | has_b)
    return out, null


def with_fills(df: DataFrame, curves: dict[str, bool], place: str) -> DataFrame:
    """``df`` with the gaps of double columns filled (see ``filled``; ``curves`` says which in between).

    Rows are in order, whole series in a partition; ``place`` is a row's position in its series, from 0."""
    def run(batches):
        def done(table: pa.Table):
            start, end = _bounds(table.column(place).combine_chunks().to_numpy() == 0)
            for c, between in curves.items():
                if table.column(c).null_count:
                    with np.errstate(all="ignore"):
                        values, null = filled(*_values(table.column(c)), start, end, between)
                    table = table.set_column(table.schema.get_field_index(c), c, pa.array(values, mask=null))
            return table.combine_chunks().to_batches()

        held, rows = [], 0
        for batch in batches:
            heads = np.flatnonzero(batch.column(batch.schema.get_field_index(place)).to_numpy() == 0)
            cut = int(heads[-1]) if len(heads) and rows + int(heads[-1]) >= _SLICE else 0  # all before it are whole series
            if cut or (len(heads) and rows >= _SLICE):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield from done(pa.Table.from_batches(held))

    return df.mapInArrow(run, df.schema)


__all__ = ["with_rolling", "with_fills", "rolling_names", "fits_arrow", "FILL_ROWS"]
