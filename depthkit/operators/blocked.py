"""Skew-safe evaluation of depth-window features for hot groups.

``partitionBy(well)`` puts a whole well in one task.  When one well may hold a large share of
the table, the series is cut into fixed-size row blocks instead:

1. exact row index per well without a per-well task: rows are bucketed by depth, bucket sizes
   are counted, offsets are a running sum over the small (well, bucket) table, and the index
   is ``offset + row_number()`` inside each bucket.  Bucket borders are depths of rows drawn from
   each large well, as many as its rows ask for, so an outlier does not widen buckets; null depths are a
   bucket of their own, before all others, and null wells are a series like any other;
2. block = index div B; the ``halo`` rows on each side of a block are copied into it, so
   every bounded frame of a core row is complete inside its block;
3. unbounded look-backs (forward fill) are exact by combining an in-block fill with a
   carry from a per-block summary table (last valid value before the block);
4. whole-series statistics (min, max, count) come from one aggregate joined back.

All windows are ``partitionBy(well, block)``: task size is bounded by B + 2*halo rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import flag, safe_div
from depthkit.operators.features import cross_curve_exprs, lithology_exprs, rolling_exprs
from depthkit.operators.ordered import fits_arrow, rolling_names, with_rolling
from depthkit.session import cut_lineage


#: Rows drawn for a bucket: every OVERSAMPLE-th of a series' drawn rows is a border, so bucket sizes vary by about a quarter.
OVERSAMPLE = 16
#: Most borders that a row is compared with in one array.
MAX_BORDERS = 64


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null keys equal to each other; keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def series_buckets(df: DataFrame, group: str | None = S.GROUP, order: str = S.ORDER,
                   bucket_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """``df`` with its group stats (``_n``/``_dmin``/``_dmax``) and ``_bkt``: a bucket of neighbours in the
    group's order.  Also returns the group stats.

    A series has about one border for ``bucket_rows`` of its own rows, so all borders together grow with the
    rows.  A row is never next to more than ``MAX_BORDERS`` or about the root of its series' borders."""
    keys = [group] if group else []
    st, biggest = _series(df, keys, order)
    return _buckets(df, st, biggest, keys, order, bucket_rows), st


def _series(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, int]:
    """The group stats, written, and the rows of the largest group."""
    st = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_dmin"), F.max(order).alias("_dmax"))
    st = cut_lineage(st, "series")
    return st, st.agg(F.max("_n")).first()[0] or 0


def _buckets(df: DataFrame, st: DataFrame, biggest: int, keys: Sequence[str], order: str, bucket_rows: int) -> DataFrame:
    buckets = -(-biggest // bucket_rows)  # only how finely series are cut; the rows are the same
    if buckets <= 1:
        j = join_null_safe(df, st, keys) if keys else df.crossJoin(F.broadcast(st))
        return j.withColumn("_bkt", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    fan = MAX_BORDERS if buckets <= MAX_BORDERS else max(MAX_BORDERS, math.isqrt(buckets) + 1)
    borders = cut_lineage(_borders(df, st, keys, order, bucket_rows, fan), "borders")  # used more than once
    per = borders.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_in") == 0, F.col("_cut")))).alias("_coarse"))
    # per-group stats: a join (broadcast only if Catalyst measures it small); global: one row
    wide = join_null_safe(st, per, keys, "left") if keys else st.crossJoin(F.broadcast(per))
    j = join_null_safe(df, wide, keys) if keys else df.crossJoin(F.broadcast(wide))
    below = lambda cuts: F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(order))), F.lit(0))
    # borders come in runs of ``fan``: first the run by its first border, then the place in it
    j = j.withColumn("_q", (F.greatest(below(F.col("_coarse")), F.lit(1)) - 1).cast("long")).drop("_coarse")
    runs = borders.groupBy(*keys, "_q").agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    j = join_null_safe(j, runs, [*keys, "_q"], "left")
    j = j.withColumn("_bkt", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.col("_q") * fan + below(F.col("_cuts"))).cast("long"))
    return j.drop("_q", "_cuts")


def _borders(df: DataFrame, st: DataFrame, keys: Sequence[str], order: str, bucket_rows: int, fan: int) -> DataFrame:
    """(keys, _cut, _q, _in): the borders of large series in order, in runs of ``fan``.

    Rows are drawn by their hash, OVERSAMPLE for a bucket, and every OVERSAMPLE-th one of a series gives a border: only
    where series are cut depends on it, no result does."""
    drawn = F.pmod(F.xxhash64(F.lit(7), *tiebreak_columns(df)), F.lit(max(1, bucket_rows // OVERSAMPLE))) == 0
    some = df.filter(drawn & F.col(order).isNotNull()).select(*keys, F.col(order).alias("_cut"))
    if keys:
        some = join_null_safe(some, st.filter(F.col("_n") > bucket_rows).select(*keys), keys, "left_semi")
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cut")
    some = some.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") % OVERSAMPLE == 0).select(*keys, "_cut").distinct()
    at = (F.row_number().over(w) - 1).cast("long")
    return some.withColumn("_r", at).select(*keys, "_cut", F.floor(F.col("_r") / fan).cast("long").alias("_q"), (F.col("_r") % fan).alias("_in"))


def series_index(df: DataFrame, group: str | None = S.GROUP, order: str = S.ORDER, bucket_rows: int = 1_000_000,
                 tie: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``_idx`` (0-based position in the group's order; ``group=None``: in the whole
    table) and ``_n``/``_dmin``/``_dmax``; also return the group stats.

    Rows with equal ``order`` (and ``tie``) get neighbouring positions in some order, the same one
    whenever it is computed, and share a bucket."""
    keys = [group] if group else []
    df = df.withColumn("_tb", tiebreak(df))
    st, biggest = _series(df, keys, order)
    ords = [F.col(order)] + ([F.col(tie)] if tie else []) + [F.col("_tb")]
    wi = Window.partitionBy(*keys, "_bkt").orderBy(*ords)
    if keys and biggest <= bucket_rows:  # a series is no larger than a bucket: rows are shuffled once, and nothing is joined
        whole, none = Window.partitionBy(*keys), F.col(order).isNull()
        j = df.withColumns({"_n": F.count(F.lit(1)).over(whole), "_dmin": F.min(order).over(whole), "_dmax": F.max(order).over(whole),
                            "_off": F.count_if(none).over(whole), "_bkt": F.when(none, F.lit(-1)).otherwise(F.lit(0)).cast("long")})
        at = F.when(F.col("_bkt") < 0, F.lit(0)).otherwise(F.col("_off")) + F.row_number().over(wi) - 1
        return j.withColumn("_idx", at).drop("_bkt", "_off", "_tb"), st
    j = _buckets(df, st, biggest, keys, order, bucket_rows)
    counts = j.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wb), F.lit(0))).drop("_c")
    j = join_null_safe(j, offsets, [*keys, "_bkt"])
    return j.withColumn("_idx", F.col("_off") + F.row_number().over(wi) - 1).drop("_bkt", "_off", "_tb"), st


def tiebreak_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def tiebreak(df: DataFrame) -> Column:
    """Fixes the order of rows that are equal in order and tie, so that a task that runs again after a lost executor agrees with its first run."""
    return F.xxhash64(*tiebreak_columns(df))


def position_exprs(order: str = S.ORDER, depth_window: tuple[float, float] = S.DEPTH_WINDOW) -> dict[str, Column]:
    """W9, W10, P14 on a frame from ``series_index``."""
    d = F.col(order)
    return {
        "depth_normalized": safe_div(d - F.col("_dmin"), F.col("_dmax") - F.col("_dmin")),
        "depth_scaled": d / 1000.0,
        "depth_from_top": d - F.col("_dmin"),
        "depth_from_bottom": F.col("_dmax") - d,
        "sequence_position": F.col("_idx").cast("long"),
        "sequence_position_norm": F.col("_idx") / F.col("_n"),
        "in_depth_window": flag(d.between(depth_window[0], depth_window[1])),
    }


def with_blocks(indexed: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Copy each row into its block (core) and, near a block edge, into the neighbour block (halo)."""
    if halo >= block_rows:
        raise ValueError("halo must be smaller than the block size")
    B = F.lit(block_rows)
    blk = F.floor(F.col("_idx") / B).cast("long")
    within = F.col("_idx") - blk * B
    copies = F.array_compact(F.array(
        F.struct(blk.alias("b"), F.lit(True).alias("core")),
        F.when((within < halo) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(False).alias("core"))),
        F.when(within >= block_rows - halo, F.struct((blk + 1).alias("b"), F.lit(False).alias("core"))),
    ))
    return indexed.withColumn("_cp", F.explode(copies)).withColumns({"_blk": F.col("_cp.b"), "_core": F.col("_cp.core")}).drop("_cp")


def in_blocks(df: DataFrame, exprs: Callable[[WindowSpec], dict[str, Column]], halo: int, group: str = S.GROUP, order: str = S.ORDER,
              tie: str | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """``df`` with window columns whose frames reach at most ``halo`` rows to either side.

    ``exprs`` gets a window over the rows of one block in the order of the series.  Null series are
    a series; null orders come first.  A task holds block_rows + 2 * halo rows of a series."""
    block_rows = max(block_rows, halo + 1)
    idx, _ = series_index(df, group, order, block_rows, tie)
    b = with_blocks(idx, block_rows, halo)
    cols = exprs(Window.partitionBy(group, "_blk").orderBy("_idx"))
    return b.withColumns(cols).filter("_core").select(*df.columns, *[c for c in cols if c not in df.columns])


def block_carry(df: DataFrame, cols: Sequence[str], group: str, block_rows: int, halo: int) -> DataFrame:
    """(group, _blk, ``_cin_<col>``): the last values of ``cols`` before a block and its leading edge, one row a block."""
    B = block_rows
    core = df.filter("_core")
    within = F.col("_idx") - F.col("_blk") * B
    aggs = []
    for c in cols:
        v = F.col(c)
        aggs.append(F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.col("_idx"))).alias(f"_la_{c}"))
        aggs.append(F.max_by(F.when(v.isNotNull() & (within <= B - halo), v),
                             F.when(v.isNotNull() & (within <= B - halo), F.col("_idx"))).alias(f"_le_{c}"))
    summ = core.groupBy(group, "_blk").agg(*aggs)
    wb = Window.partitionBy(group).orderBy("_blk")
    carry = {}
    for c in cols:
        older = F.last(F.col(f"_la_{c}"), ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1))
        carry[f"_cin_{c}"] = F.coalesce(F.col(f"_le_{c}"), older)
    # carry into block b = summary of block b-1 (early part) or anything older
    return summ.select(group, (F.col("_blk") + 1).alias("_blk"), *[v.alias(k) for k, v in carry.items()])


def carried_exprs(cols: Sequence[str], w: WindowSpec, block_rows: int, halo: int) -> dict[str, Column]:
    """Exact forward fill of ``cols`` (``_ff_<col>``) on a blocked frame that has the block's ``_cin_<col>``."""
    edge = F.col("_idx") == F.col("_blk") * block_rows - halo  # outer leading edge: derived values incomplete there
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    return {f"_ff_{c}": F.coalesce(F.last(F.when(~edge, F.col(c)), ignorenulls=True).over(before), F.col(f"_cin_{c}")) for c in cols}


def engineer_features_blocked(df: DataFrame, target: str = S.TARGET, windows: Sequence[int] = S.ROLLING_WINDOWS,
                              lags: Sequence[int] = S.DIFF_LAGS, group: str = S.GROUP, order: str = S.ORDER,
                              depth_window: tuple[float, float] = S.DEPTH_WINDOW, quantiles: bool = True,
                              ratio_curves_: Sequence[str] | None = None, block_rows: int = 1_000_000,
                              halo: int | None = None, tie: str | None = None) -> DataFrame:
    """All per-row features of one target with bounded tasks for any group size.

    Rows with a null group are one series; rows with a null ``order`` come first in theirs."""
    t = target
    back = max([w - 1 - (w - 1) // 2 for w in windows] + [max(lags) if lags else 0])
    halo = halo or (back + 6)
    base_cols = list(df.columns)
    idx, st = series_index(df, group, order, bucket_rows=block_rows, tie=tie)
    # a struct is a key that is never null: the join to the carry and all windows share one shuffle, of the input's columns only
    b = with_blocks(idx, block_rows, halo).withColumn("_g", F.struct(F.col(group).alias("g")))
    w = Window.partitionBy("_g", "_blk").orderBy("_idx")
    in_arrow = df.schema[t].dataType.typeName() == "double" and len(windows) > 0 and fits_arrow(df)
    roll = {} if in_arrow else rolling_exprs(t, w, windows, quantiles)
    fr3 = w.rowsBetween(-1, 1)
    smooth = F.when(F.count(F.col(t)).over(fr3) == 3, F.avg(F.col(t)).over(fr3))
    carry = block_carry(b.select("_g", "_blk", "_idx", "_core", t).withColumn("_sm", smooth), [t, "_sm"], "_g", block_rows, halo)
    b = b.join(carry, ["_g", "_blk"], "left")
    b = b.withColumns({**roll, "_sm": smooth, **{f"{t}_diff_{k}": F.col(t) - F.lag(F.col(t), k).over(w) for k in lags}})
    b = b.withColumns(carried_exprs([t, "_sm"], w, block_rows, halo))
    first, last = F.col("_idx") == 0, F.col("_idx") == F.col("_n") - 1

    def grad(f: str) -> Column:
        fc = F.col(f)
        prev, nxt = F.lag(fc, 1).over(w), F.lead(fc, 1).over(w)
        return (F.when(first & last, F.lit(None).cast("double")).when(first, nxt - fc).when(last, fc - prev)
                .otherwise((nxt - prev) / 2.0))

    lvl_b = {f"{t}_gradient": grad(f"_ff_{t}"),
             **{f"{t}_pct_change_{k}": safe_div(F.col(f"_ff_{t}"), F.lag(F.col(f"_ff_{t}"), k).over(w)) - 1 for k in lags}}
    b = b.withColumns(lvl_b)
    b = b.withColumns({f"{t}_gradient_smooth": grad("_ff__sm"), f"{t}_curvature": grad(f"{t}_gradient")})
    depth = position_exprs(order, depth_window)
    grad_names = [f"{t}_gradient", f"{t}_gradient_smooth", f"{t}_curvature"]
    for k in lags:
        grad_names += [f"{t}_diff_{k}", f"{t}_pct_change_{k}"]
    litho = lithology_exprs(base_cols)
    cross = cross_curve_exprs(base_cols, ratio_curves_)
    if in_arrow:  # after all windows, whose order of rows it needs
        b = b.select(*base_cols, *grad_names, "_g", "_blk", "_idx", "_core", "_n", "_dmin", "_dmax", F.lag(F.lit(True)).over(w).isNull().alias("_first"))
        b = with_rolling(b.sortWithinPartitions("_g", "_blk", "_idx").drop("_g", "_blk"), t, windows, quantiles, "_first")
        roll = rolling_names(t, windows, quantiles)
    core = b.filter("_core")
    return core.select(*base_cols, *roll, *grad_names, *[v.alias(k) for k, v in depth.items()],
                       *[v.alias(k) for k, v in litho.items()], *[v.alias(k) for k, v in cross.items()])

