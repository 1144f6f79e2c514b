"""Hand-computed micro fixtures (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import series
from depthkit.functions.quantiles import group_quantiles
from depthkit.operators import clean, features, impute, quality, resample, scale

X = [50, 60, None, 80, 300, 20, 40]


def col(df, name, order="DEPTH"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def approx(a, b, tol=1e-5):
    assert len(a) == len(b), (a, b)
    for x, y in zip(a, b):
        if y is None:
            assert x is None, (a, b)
        else:
            assert x is not None and abs(x - y) <= tol * max(1.0, abs(y)), (a, b)


def test_rolling_w5(spark):
    out = features.rolling_features(series(spark, X), "GR", [5])
    approx(col(out, "GR_roll_mean_5"), [55, 63.333333, 122.5, 115, 110, 110, 120])
    approx(col(out, "GR_roll_std_5"), [7.071068, 15.275252, 118.988795, 125.830574, 129.099445, 129.099445, 156.204994])
    approx(col(out, "GR_roll_min_5"), [50, 50, 50, 20, 20, 20, 20])
    approx(col(out, "GR_roll_max_5"), [60, 80, 300, 300, 300, 300, 300])
    approx(col(out, "GR_roll_q25_5"), [52.5, 55, 57.5, 50, 35, 35, 30])
    approx(col(out, "GR_roll_q75_5"), [57.5, 70, 135, 135, 135, 135, 170])


def test_rolling_w10_min_periods(spark):
    out = features.rolling_features(series(spark, X), "GR", [10])
    approx(col(out, "GR_roll_mean_10"), [122.5, 102, 91.666667, 91.666667, 91.666667, 91.666667, 100])


def test_gradients(spark):
    out = features.gradient_features(series(spark, X), "GR")
    approx(col(out, "GR_gradient"), [10, 5, 10, 120, -30, -130, 20])
    approx(col(out, "GR_curvature"), [-5, 0, 57.5, -20, -125, 25, 150])
    approx(col(out, "GR_gradient_smooth"), [None, None, None, None, None, -6.666667, 0])
    approx(col(out, "GR_diff_1"), [None, 10, None, None, 220, -280, 20])
    approx(col(out, "GR_diff_3"), [None, None, None, 30, 240, None, -40])
    approx(col(out, "GR_pct_change_1"), [None, 0.2, 0, 0.333333, 2.75, -0.933333, 1])
    approx(col(out, "GR_pct_change_3"), [None, None, None, 0.6, 4, -0.666667, -0.5])


def test_mad(spark):
    out = quality.mad_outliers(series(spark, X), "GR").first()
    assert out["median"] == 55 and out["mad"] == 20 and out["limit"] == 155 and out["n_outliers"] == 1


def test_interpolate_index(spark):
    out = impute.interpolate_index(series(spark, [None, 60, None, None, 90, None]), ["GR"])
    approx(col(out, "GR"), [60, 60, 70, 80, 90, 90])


def test_resample(spark):
    d = [100, 100.5, 101.7, 103.2]
    out = resample.resample(series(spark, [10, None, 30, 40], d), ["GR"], step=1.0)
    approx(col(out, "DEPTH"), [100, 101.066667, 102.133333, 103.2])
    approx(col(out, "GR"), [10, 22.54902, 32.888889, 40])
    out2 = resample.resample(series(spark, [None, 20, 30, None], d), ["GR"], step=1.0)
    approx(col(out2, "GR"), [None, 24.722222, None, None])


def test_resample_duplicate_depth_keeps_first(spark):
    out = resample.resample(series(spark, [10, 99, 20], [0.0, 0.0, 2.0]), ["GR"], step=1.0)
    approx(col(out, "GR"), [10, 15, 20])


def test_intensity_bins(spark):
    df = series(spark, [0, 10, 30, 30.1, 300, 301])
    out = features.lithology_features(df).orderBy("DEPTH").collect()
    labels = []
    for r in out:
        hit = [k for k in ["very_low", "low", "medium", "high", "very_high", "nan"] if r[f"gr_{k}"] == 1]
        assert len(hit) == 1
        labels.append(hit[0])
    assert labels == ["nan", "very_low", "very_low", "low", "very_high", "nan"]


def test_boxcox_fixture(spark):
    df = series(spark, [50, 60, 80, 300, 20, 40])
    prof = scale.boxcox_profile(df, "GR", [k / 100 for k in range(-200, 201)])
    best = prof.orderBy(F.col("loglik").desc()).first()
    assert abs(best["lambda"] - (-0.36)) < 1e-9
    assert abs(best["loglik"] - (-23.295843)) < 1e-5
    lam, ll = scale.fit_boxcox(df, "GR")
    assert abs(lam + 0.36) < 0.01 and ll >= best["loglik"] - 1e-9


def test_clip_keeps_null(spark):
    out = clean.clip_ranges(series(spark, [None, 5, 400]), {"GR": (10.0, 250.0)})
    approx(col(out, "GR"), [None, 10, 250])


def test_sentinels(spark):
    out = quality.apply_sentinels(series(spark, [-999.25, -9999, -999, 5, float("nan")]), ["GR"])
    assert col(out, "GR") == [None, None, None, 5.0, None]


def test_group_quantiles_match_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 5000), "v": rng.normal(size=5000).round(3)})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"], accuracy=100).collect()}
    for g, sub in pdf.groupby("g"):
        for q, n in [(0.1, "a"), (0.5, "b"), (0.9, "c")]:
            assert math.isclose(got[g][n], sub["v"].quantile(q), rel_tol=1e-9, abs_tol=1e-9)


def test_impute_policy_branches(spark):
    # GR: 1 of 4 missing (25 %) -> high branch: median fill; RHOB complete
    df = spark.createDataFrame([(1, float(i), v, 2.0) for i, v in enumerate([10.0, None, 30.0, 50.0])],
                               "well_api long, DEPTH double, GR double, RHOB double")
    out = impute.impute_policy(df, ["GR", "RHOB"])
    assert col(out, "GR") == [10.0, 30.0, 30.0, 50.0]
    res, flags = impute.impute_policy(df, ["GR", "RHOB"], with_flags=True)
    f = flags.collect()
    assert len(f) == 1 and f[0]["curve"] == "GR" and f[0]["issue"] == "high_missing"


def test_splits_disjoint_and_covering(spark):
    from depthkit.operators import split
    df = spark.range(0, 50).select((F.col("id") % 17).alias("well_api"), F.lit("OP").alias("operator"), F.col("id").cast("double").alias("DEPTH"))
    s = split.split_wells(df, 0.6, 0.2).collect()
    assert len(s) == 17 and len({r["well_api"] for r in s}) == 17
    counts = {k: sum(1 for r in s if r["split"] == k) for k in ["train", "validation", "test"]}
    assert counts == {"train": 10, "validation": 3, "test": 4}


@pytest.mark.parametrize("fn", [scale.scale_standard])
def test_scaler_invariants(spark, fn):
    df = series(spark, [1, 2, 3, 4, None])
    out = fn(df, ["GR"]).agg(F.avg("GR").alias("m"), F.stddev_pop("GR").alias("s")).first()
    assert abs(out["m"]) < 1e-12 and abs(out["s"] - 1) < 1e-12


def test_rows_null_in_all_neighbours_stay_null(spark):
    """Two curves NULL in the same rows: neither has a neighbour value there, so both stay NULL."""
    from depthkit.operators.impute import impute_policy
    rows = [(1, float(i), None if i < 3 else float(i), None if i < 3 else 100.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows + [(None, 5.0, None, 1.0)], "well_api long, DEPTH double, A double, B double")
    out = {(r["well_api"], r["DEPTH"]): (r["A"], r["B"]) for r in impute_policy(df, ["A", "B"]).collect()}
    assert len(out) == 41 and out[(None, 5.0)] == (None, 1.0)
    assert all(out[(1, float(i))] == (None, None) for i in range(3)) and out[(1, 7.0)] == (7.0, 107.0)


def test_folds_are_never_empty(spark):
    from depthkit.operators.models import with_folds
    df = spark.createDataFrame([(w, float(i)) for w in (1, 2, 3) for i in range(4)] + [(None, 0.0)], "well_api long, x double")
    out = with_folds(df, k=3)
    assert out.filter("well_api is not null").select("well_api", "fold").distinct().select("fold").distinct().count() == 3
    assert out.count() == 13


def test_constant_target_and_ties(spark):
    from depthkit.operators.evaluate import best_by
    from depthkit.operators.scale import boxcox_transform, zscore_filter
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, None)], "well_api long, GR double")
    assert zscore_filter(df, "GR").count() == 3
    out, _ = boxcox_transform(df, "GR", lam=0.5)
    assert {r["GR_transformed"] for r in out.collect()} == {0.0, None}
    t = spark.createDataFrame([(k, 0.5) for k in ("delta", "alpha", "gamma", "beta")] + [("aa", None), ("zz", 0.1)], "model string, r2 double")
    assert best_by(t, "model", "r2").collect()[0].asDict() == {"model": "alpha", "r2": 0.5}


def test_fitted_scaler_round_trip(spark):
    from depthkit.operators.scale import apply_scaler, fit_scaler
    df = spark.createDataFrame([(float(i), 7.0, float(i * i)) for i in range(20)], "a double, b double, c double")
    for kind in ("standard", "minmax", "robust"):
        sc = fit_scaler(df, ["a", "b", "c"], kind)
        back = apply_scaler(apply_scaler(df, sc), sc, inverse=True)
        assert sorted((round(r["a"], 9), r["b"], round(r["c"], 9)) for r in back.collect()) == sorted((r["a"], r["b"], r["c"]) for r in df.collect())
        assert sc.filter("feature = 'b'").first()["scale"] == 1.0


def test_cluster_needs_a_shared_folder():
    import pytest
    from depthkit.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
