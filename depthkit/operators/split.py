"""Group-wise train/validation/test splits.

Wells are ordered by ``md5('<well>:<seed>')`` (engine-independent, seeded), numbered once
over the *distinct groups* (small next to the rows), and the resulting ``(group, split)``
table is joined back; Spark broadcasts it when its measured size is below the broadcast
threshold and shuffle-joins it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.functions.exprs import md5_order, numeric_curves


def well_order(df: DataFrame, group: str = S.GROUP, seed: int = 42, partition: str | None = None) -> DataFrame:
    """(group, [partition], n, rank) with rank 0.. in seeded md5 order.

    The rank is computed without a single-task window: the md5 prefix is used as a numeric
    order key and ``blocked.series_index`` numbers rows through bucket counts and offsets."""
    from depthkit.operators.blocked import series_index
    keys = [group] + ([partition] if partition else [])
    wells = df.groupBy(group).agg(*([F.min(partition).alias(partition)] if partition else [])) if partition else df.select(group).distinct()
    h = md5_order(group, seed)
    # 52 leading bits of the md5 as an exact double, then the full hex and the id break ties
    key = F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double")
    t = wells.withColumns({"_h": h, "_hk": key})
    t = t.withColumn("_tie", F.concat(F.col("_h"), F.lit("|"), F.col(group).cast("string")))
    idx, st = series_index(t, partition, "_hk", bucket_rows=1_000_000, tie="_tie")
    return idx.select(*keys, F.col("_idx").cast("int").alias("rank"), F.col("_n").alias("n"))


def _cut(rank: Column, n: Column, train: float, val: float, min_val: int) -> Column:
    n_train = F.greatest(F.lit(1), F.floor(n * F.lit(float(train))))
    n_val = F.greatest(F.lit(min_val), F.floor(n * F.lit(float(val))))
    short = (n - n_train - n_val) < 1
    n_val = F.when(short, F.greatest(F.lit(0), n - n_train - 1)).otherwise(n_val)
    return F.when(rank < n_train, "train").when(rank < n_train + n_val, "validation").otherwise("test")


def split_wells(df: DataFrame, train: float = 0.6, val: float = 0.2, group: str = S.GROUP,
                operator: str = "operator", seed: int = 42) -> DataFrame:
    """M1: (group, split).

    With a validation share and at least 3 groups: one seeded global order, cut at
    ``max(1, int(n*train))`` and ``max(1, int(n*val))``, at least one test group.  Otherwise
    per operator: 1 group -> train, 2 -> train + test, more -> the same cut per operator
    (validation may be empty).
    """
    n_groups = df.select(group).distinct().count() if val > 0 else 0
    if val > 0 and n_groups >= 3:
        o = well_order(df, group, seed)
        return o.select(group, _cut(F.col("rank"), F.col("n"), train, val, 1).alias("split"))
    o = well_order(df, group, seed, partition=operator)
    n, r = F.col("n"), F.col("rank")
    n_train = F.greatest(F.lit(1), F.floor(n * F.lit(float(train))))
    n_val = F.greatest(F.lit(0), F.floor(n * F.lit(float(val))))
    per_op = F.when(r < n_train, "train").when(r < n_train + n_val, "validation").otherwise("test")
    split = F.when(n == 1, "train").when(n == 2, F.when(r == 0, "train").otherwise("test")).otherwise(per_op)
    return o.select(group, split.alias("split"))


def assign_split(df: DataFrame, splits: DataFrame, group: str = S.GROUP) -> DataFrame:
    """Attach the split label to every row (inner join on the group)."""
    return df.join(splits, group)


def split_stats(df: DataFrame, splits: DataFrame, group: str = S.GROUP,
                features: Sequence[str] | None = None) -> DataFrame:
    """Per split: groups, records, mean feature completeness %, share of all records."""
    feats = list(features) if features is not None else numeric_curves(df)
    j = assign_split(df, splits, group)
    comp = sum((F.count(F.col(c)) / F.count(F.lit(1)) for c in feats), F.lit(0.0)) / float(len(feats)) * 100.0
    per = j.groupBy("split").agg(
        F.countDistinct(group).alias("wells"), F.count(F.lit(1)).alias("records"), comp.alias("completeness_pct"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return per.crossJoin(F.broadcast(total)).select(
        "split", "wells", "records", "completeness_pct", (F.col("records") / F.col("_total")).alias("ratio_actual"))


def wells_per_operator(df: DataFrame, group: str = S.GROUP, operator: str = "operator") -> DataFrame:
    """Operator of a group = its first row's operator (by depth); count groups per operator."""
    first = df.groupBy(group).agg(F.min_by(operator, S.ORDER).alias(operator))
    return first.groupBy(operator).agg(F.count(F.lit(1)).alias("wells"))


def stable_sample(df: DataFrame, key: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """A seeded sample of at most ``n`` rows: distributed top-n by md5 of the row key."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return df.withColumn("_h", md5_order(k, seed)).orderBy("_h", *key).limit(n).drop("_h")


def apportioned_sizes(n: Column, ratios: Sequence[float], min_wells: int) -> list[Column]:
    """Train, validation and test sizes of ``n`` groups: ``min(min_wells, n div 3)`` each, the rest by largest remainder.

    Shares are what the ratios ask beyond those minimum sizes; equal remainders go to train, then
    test, then validation."""
    least = F.least(F.lit(min_wells), F.floor(n / 3)).cast("long")
    rest = n - 3 * least
    want = [F.greatest(n * F.lit(float(r)) - least, F.lit(0.0)) for r in ratios]
    total = want[0] + want[1] + want[2]
    quota = [F.coalesce(F.try_divide(rest * w, total), F.lit(0.0)) + F.lit(1e-9) for w in want]
    whole = [F.floor(q).cast("long") for q in quota]
    over = rest - whole[0] - whole[1] - whole[2]
    part = [F.floor((q - w) * 1e6) for q, w in zip(quota, whole)]
    turn = [0, 2, 1]  # of train, validation, test among equal remainders
    sizes = []
    for i in range(3):
        ahead = sum(((part[j] > part[i]) | ((part[j] == part[i]) & F.lit(turn[j] < turn[i]))).cast("int") for j in range(3) if j != i)
        sizes.append(least + whole[i] + (ahead < over).cast("int"))
    return sizes


def split_apportioned(df: DataFrame, ratios: Sequence[float] = (0.6, 0.2, 0.2), min_wells: int = 3, group: str = S.GROUP,
                      operator: str = "operator", seed: int = 42) -> DataFrame:
    """M1, stratified: (group, split) with the ratios held inside every operator.

    Each operator's groups are cut, in their seeded order, at the sizes of ``apportioned_sizes``; one
    group goes to train, two to train and test.  Groups without an operator are a stratum."""
    o = well_order(df.filter(F.col(group).isNotNull()), group, seed, partition=operator)
    train, val, _ = apportioned_sizes(F.col("n"), ratios, min_wells)
    r = F.col("rank")
    return o.select(group, F.col(operator), F.when(r < train, "train").when(r < train + val, "validation").otherwise("test").alias("split"))
