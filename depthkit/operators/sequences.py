"""Sliding input sequences for sequence models.

For each group with n >= 2L rows (depth order), target rows i in [L, n-L) stepping by
``step`` get the feature vectors of rows i-L..i-1.  Features are the columns that are
complete within the group; rows with a NULL target are skipped.  The frame is a bounded
``rowsBetween(-L, -1)`` window, so memory per task is O(L x features), never a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import full_frame, series_window
from depthkit.session import cut_lineage


def sequences(df: DataFrame, features: Sequence[str], target: str = S.TARGET, length: int = S.SEQUENCE_LENGTH,
              step: int = S.SEQUENCE_STEP, group: str = S.GROUP, order: str = S.ORDER,
              carry: Sequence[str] = (), skew: str = "on", block_rows: int = 1_000_000) -> DataFrame:
    """(group, depth, [carry], sequence_idx, sequence array<array<double>>, features_used, target).

    Series are cut into blocks, so no task holds a whole group; ``skew="off"`` is the plan
    with one task per group, for callers who know that groups are small (same result)."""
    if skew == "on":
        return _sequences_blocked(df, features, target, length, step, group, order, carry, block_rows)
    w = series_window(group, order)
    wf = full_frame(w)
    feats = list(features)
    complete = {f"_ok_{c}": F.min(F.col(c).isNotNull().cast("int")).over(wf) == 1 for c in feats}
    t = df.select(group, order, *carry, F.col(target).alias("_y"), *feats,
                  (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(wf).alias("_n"),
                  *[v.alias(k) for k, v in complete.items()])
    vec = F.filter(F.array(*[F.when(F.col(f"_ok_{c}"), F.col(c).cast("double")) for c in feats]), lambda x: x.isNotNull())
    used = F.filter(F.array(*[F.when(F.col(f"_ok_{c}"), F.lit(c)) for c in feats]), lambda x: x.isNotNull())
    t = t.select(group, order, *carry, "_y", "_i", "_n", used.alias("features_used"),
                 F.collect_list(vec).over(w.rowsBetween(-length, -1)).alias("sequence"))
    keep = ((F.col("_n") >= 2 * length) & (F.col("_i") >= length) & (F.col("_i") < F.col("_n") - length)
            & (((F.col("_i") - length) % step) == 0) & F.col("_y").isNotNull() & (F.size("features_used") > 0))
    kept = t.filter(keep)
    w2 = Window.partitionBy(group).orderBy(order)
    return kept.select(group, F.col(order).alias("depth"), *carry, (F.row_number().over(w2) - 1).alias("sequence_idx"),
                       "sequence", "features_used", F.col("_y").alias("target"))


def _sequences_blocked(df, features, target, length, step, group, order, carry, block_rows):
    """W15 on (group, block) partitions: exact index, look-back halo of ``length`` rows, the
    per-group completeness mask and the kept-sequence numbering from small aggregates."""
    from depthkit.operators.blocked import join_null_safe, series_index, with_blocks

    feats = list(features)
    df = cut_lineage(df.select(*dict.fromkeys([group, order, *carry, target, *feats])), "sequence-input")  # read by the index, the masks and the frames
    idx, _ = series_index(df, group, order, bucket_rows=block_rows)
    masks = cut_lineage(df.groupBy(group).agg(*[F.min(F.col(c).isNotNull().cast("int")).alias(f"_ok_{c}") for c in feats]), "sequence-masks")
    idx = join_null_safe(idx, masks, [group])
    some = F.lit(False)
    for c in feats:
        some = some | (F.col(f"_ok_{c}") == 1)
    keep = ((F.col("_n") >= 2 * length) & (F.col("_idx") >= length) & (F.col("_idx") < F.col("_n") - length)
            & (((F.col("_idx") - length) % step) == 0) & F.col(target).isNotNull() & some)
    # sequence_idx = rank among kept rows of the group: per-block counts + offsets (small table), before rows carry sequences
    idx = idx.withColumns({"_keep": keep, "_b": F.floor(F.col("_idx") / block_rows).cast("long")})
    per_blk = idx.groupBy(group, "_b").agg(F.count_if("_keep").alias("_c"))
    wb = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_blk.select(group, F.col("_b").alias("_blk"), F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_first"))
    b = join_null_safe(with_blocks(idx.drop("_b"), block_rows, length), offs, [group, "_blk"], "left")  # a halo may lie in a block without rows
    w = Window.partitionBy(group, "_blk").orderBy("_idx")
    vec = F.filter(F.array(*[F.when(F.col(f"_ok_{c}") == 1, F.col(c).cast("double")) for c in feats]), lambda x: x.isNotNull())
    used = F.filter(F.array(*[F.when(F.col(f"_ok_{c}") == 1, F.lit(c)) for c in feats]), lambda x: x.isNotNull())
    mine = F.col("_core") & F.col("_keep")
    before = F.count_if(mine).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    t = b.select(group, order, *carry, mine.alias("_mine"), (F.col("_first") + before).cast("int").alias("sequence_idx"), F.col(target).alias("_y"),
                 used.alias("features_used"), F.collect_list(vec).over(w.rowsBetween(-length, -1)).alias("sequence"))
    return t.filter("_mine").select(group, F.col(order).alias("depth"), *carry, "sequence_idx", "sequence", "features_used", F.col("_y").alias("target"))


def sequence_metadata(seqs: DataFrame, group: str = S.GROUP, carry: Sequence[str] = ()) -> DataFrame:
    """K8: one row per sequence without its values: group, depth, carried columns, index, steps and number of features."""
    return seqs.select(group, "depth", *carry, "sequence_idx", F.size("sequence").alias("length"), F.size("features_used").alias("n_features"))
