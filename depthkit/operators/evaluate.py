"""Evaluation aggregates on any (actual, predicted) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthkit import schema as S
from depthkit.session import cut_lineage


def target_rows(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Rows with a target value."""
    return df.filter(F.col(target).isNotNull())


def feature_columns(df: DataFrame, target: str = S.TARGET, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric feature columns, excluding ids, depth, the target and its transform."""
    skip = set(S.ID_COLUMNS) | {target, f"{target}_transformed", S.SRC_ROW, "split"} | set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip
            and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]


def feature_family(name: str) -> str:
    """Training-side family of a feature name (rolling / gradient / ratio / base)."""
    if "_roll_" in name:
        return "rolling"
    if any(k in name for k in ("gradient", "_diff_", "_pct_change", "curvature")):
        return "gradient"
    if any(k in name for k in ("_ratio", "_product")):
        return "ratio"
    return "base"


def family_expr(c: Column) -> Column:
    """SQL version of ``feature_family`` for long (feature, value) tables."""
    return (F.when(c.contains("_roll_"), "rolling")
            .when(c.contains("gradient") | c.contains("_diff_") | c.contains("_pct_change") | c.contains("curvature"), "gradient")
            .when(c.contains("_ratio") | c.contains("_product"), "ratio").otherwise("base"))


def band_expr(y: str | Column, bands=S.TARGET_BANDS) -> Column:
    """P20: lithology band of the target value, [lo, hi) per band."""
    yc = F.col(y) if isinstance(y, str) else y
    e = None
    for lo, hi, name in bands:
        cond = (yc >= lo) & (yc < hi)
        e = F.when(cond, name) if e is None else e.when(cond, name)
    return e


def regression_metrics(df: DataFrame, y: str, p: str, group: Sequence[str] = (),
                       valid_range: tuple[float, float] = S.VALID_PREDICTION_RANGE) -> DataFrame:
    """A16, A18, A19 in one aggregate: r2, rmse, mae, validity %, residual and value moments."""
    yc, pc = F.col(y), F.col(p)
    r = yc - pc
    n = F.count(F.lit(1))
    sse = F.sum(r * r)
    sst = F.var_pop(yc) * n
    return df.filter(yc.isNotNull() & pc.isNotNull()).groupBy(*group).agg(
        n.alias("n"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
        F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(r)).alias("mae"),
        (F.avg(pc.between(valid_range[0], valid_range[1]).cast("double")) * 100).alias("validity_pct"),
        F.avg(r).alias("residual_mean"),
        F.stddev_pop(r).alias("residual_std"),
        F.min(pc).alias("pred_min"), F.max(pc).alias("pred_max"), F.avg(pc).alias("pred_mean"),
        F.stddev_pop(pc).alias("pred_std"),
        F.min(yc).alias("actual_min"), F.max(yc).alias("actual_max"), F.avg(yc).alias("actual_mean"),
        F.stddev_samp(yc).alias("actual_std"),
    )


def band_r2(df: DataFrame, y: str, p: str, group: Sequence[str] = ()) -> DataFrame:
    """r2 / rmse / n per lithology band of the actual value."""
    b = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("band", band_expr(y))
    r = F.col(y) - F.col(p)
    n = F.count(F.lit(1))
    return b.groupBy(*group, "band").agg(
        n.alias("n"), (1 - F.try_divide(F.sum(r * r), F.var_pop(y) * n)).alias("r2"), F.sqrt(F.avg(r * r)).alias("rmse"))


def original_scale_metrics(df: DataFrame, y: str, p: str, lam: float, mean: float, std: float, group: Sequence[str] = ()) -> DataFrame:
    """``regression_metrics`` after undoing standardization and Box-Cox on both columns."""
    from depthkit.operators.scale import inverse_boxcox
    back = df.withColumns({y: inverse_boxcox(F.col(y), lam, mean, std), p: inverse_boxcox(F.col(p), lam, mean, std)})
    return regression_metrics(back, y, p, group)


def residual_histogram(df: DataFrame, y: str, p: str, bins: int = 30, group: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram of residuals between their min and max (last bin closed)."""
    keys = list(group)
    r = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*keys, (F.col(y) - F.col(p)).alias("_r"))
    # written first, so that Catalyst knows how small it is: a shuffled join would put all rows of a group in one task
    st = cut_lineage(r.groupBy(*keys).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi")), "residual-range")
    j = r.join(st, keys) if keys else r.crossJoin(F.broadcast(st))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col("_r") - F.col("_lo"), width)), F.lit(bins - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")
    h = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    w2 = (F.col("_hi") - F.col("_lo")) / bins
    return h.select(*keys, "bin", (F.col("_lo") + F.col("bin") * w2).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w2).alias("bin_hi"), "count")


def depth_error(df: DataFrame, y: str, p: str, group: str | Sequence[str] = S.GROUP, order: str = S.ORDER, bin_size: float = 100.0) -> DataFrame:
    """Mean absolute error per (group, depth bin) — the table behind an error-vs-depth chart."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    keys = [group] if isinstance(group, str) else list(group)
    return d.groupBy(*keys, (F.floor(F.col(order) / bin_size) * bin_size).alias("depth_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def cv_summary(fold_metrics: DataFrame, model: str = "model", score: str = "r2") -> DataFrame:
    """Mean and population std of the fold scores per model."""
    return fold_metrics.groupBy(model).agg(
        F.count(F.lit(1)).alias("folds"), F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))


def best_by(df: DataFrame, key: str, score: str) -> DataFrame:
    """O3: the key with the highest score (ties -> smallest key), as one row; null scores never win."""
    known = df.filter(F.col(score).isNotNull())
    best = known.agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("_b"))
    return best.filter(F.col("_b").isNotNull()).select(F.col("_b.k").alias(key), (-F.col("_b.s")).alias(score))


def top_k(df: DataFrame, value: str, name: str = "feature", k: int = 10) -> DataFrame:
    """O2: top-k by value with name tie-break (distributed take-ordered)."""
    return df.orderBy(F.col(value).desc(), F.col(name)).limit(k)


def family_attribution(long: DataFrame, feature: str = "feature", value: str = "attribution") -> DataFrame:
    """Mean |attribution| per feature and its sum per family."""
    per = long.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    per = per.withColumn("family", family_expr(F.col(feature)))
    return per.groupBy("family").agg(F.sum("mean_abs").alias("total"), F.count(F.lit(1)).alias("features"))


def linear_attributions(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Exact additive attributions of the univariate least-squares fits: slope_j * (x_j - mean_j).

    Long output (row id columns dropped): (feature, attribution)."""
    aggs = []
    for c in features:
        aggs += [F.regr_slope(target, c).alias(f"_b_{c}"), F.avg(c).alias(f"_m_{c}")]
    st = df.filter(F.col(target).isNotNull()).agg(*aggs)
    j = df.crossJoin(F.broadcast(st))
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"_m_{c}")) * F.col(f"_b_{c}")).alias("attribution"))
                    for c in features])
    return j.select(F.explode(arr).alias("_a")).select("_a.feature", "_a.attribution").filter(F.col("attribution").isNotNull())
