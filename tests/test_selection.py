"""Co-moments, mutual information, drift, stratified sizes, formations, attribution and runs against plain Python."""

import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthkit.operators import attribution, comoment, formations, iforest, selection, split
from depthkit.session import scratch_path
from depthkit.sinks import runs


@pytest.mark.parametrize("tile", [2, 128])
def test_comoments_equal_numpy(spark, tile):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1.0, (400, 5))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.1, 400)
    x[:, 4] = 7.25
    x[rng.random((400, 5)) < 0.2] = np.nan
    names = list("abcde")
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.curve_a, r.curve_b): r for r in comoment.pair_statistics(df, names, tile).collect()}
    assert len(got) == 10
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b, r = x[both, i], x[both, j], got[names[i], names[j]]
            assert r.n == both.sum()
            if j == 4:
                assert r.corr is None
            else:
                assert math.isclose(r["corr"], np.corrcoef(a, b)[0, 1], rel_tol=1e-6, abs_tol=1e-9)
                assert math.isclose(r.slope, np.polyfit(a - a.mean(), b, 1)[0], rel_tol=1e-6, abs_tol=1e-9)
    kept = {r.feature: (r.kept, r.reason) for r in comoment.select_uncorrelated(df, names, 1e-3, 0.98, tile).collect()}
    assert kept == {"a": (True, None), "b": (False, "a"), "c": (True, None), "d": (True, None), "e": (False, "variance")}
    assert all(not r.kept for r in comoment.select_uncorrelated(df.limit(0), names).collect())


def test_mutual_information_ranks_dependence(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=3000)
    rows = [(float(v), float(v * v), float(e), None, float(v + 0.5 * e)) for v, e in zip(y, rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "y double, square double, noise double, nothing double, noisy double").repartition(4)
    got = {r.feature: r for r in selection.mutual_information(df, ["noise", "square", "nothing", "noisy"], "y").collect()}
    assert [f for f, _ in sorted(got.items(), key=lambda r: r[1]["rank"])][:2] == ["square", "noisy"] or got["noisy"]["rank"] <= 2
    assert got["nothing"].n == 0 and got["nothing"].mi == 0 and got["noise"].mi < 0.05 < got["noisy"].mi
    constant = selection.mutual_information(df.withColumn("y", F.lit(1.0)), ["noise"], "y").first()
    assert abs(constant.mi) < 1e-12


def test_drift_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1), None) for _ in range(500)] + [("b", rng.gauss(0.5, 1), 1.0) for _ in range(300)] + [("c", float(rng.randint(0, 3)), None) for _ in range(200)]
    rows += [(None, 9.0, 9.0), ("a", None, None), ("d", None, None)]
    df = spark.createDataFrame(rows, "part string, x double, y double").repartition(4)
    got = {(r.curve, r.part): r for r in selection.drift(df, ["x", "y"], "part", "a").collect()}
    assert set(got) == {(c, p) for c in "xy" for p in "bcd"}
    ref = sorted(v for p, v, _ in rows if p == "a" and v is not None)
    for p in "bc":
        own = sorted(v for q, v, _ in rows if q == p)
        share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
        ks = max(abs(share(ref, v) - share(own, v)) for v in ref + own)
        edges = np.quantile(ref, [i / 10 for i in range(1, 10)])
        cut = lambda xs: np.maximum(np.bincount([(v > edges).sum() for v in xs], minlength=10) / len(xs), 1e-6)
        psi = ((cut(own) - cut(ref)) * np.log(cut(own) / cut(ref))).sum()
        assert math.isclose(got["x", p].ks, ks, rel_tol=1e-9) and math.isclose(got["x", p].psi, psi, rel_tol=1e-6)
    assert got["x", "d"].ks is None and got["y", "b"].psi is None and got["y", "b"].n == 300 and got["y", "b"].n_reference == 0


def test_apportioned_sizes(spark):
    ns = list(range(1, 60))
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    for ratios in ((0.6, 0.2, 0.2), (0.8, 0.15, 0.05), (0.34, 0.33, 0.33)):
        sizes = split.apportioned_sizes(F.col("n"), ratios, 3)
        for r in df.select("n", *[s.alias(k) for s, k in zip(sizes, ("a", "b", "c"))]).collect():
            assert r.a + r.b + r.c == r.n and min(r.a, r.b, r.c) >= min(3, r.n // 3), (ratios, r)
            if r.n >= 45:
                assert all(abs(v - max(3, r.n * q)) <= 2 for v, q in zip((r.a, r.b, r.c), ratios)), (ratios, r)
    wells = spark.createDataFrame([(i, f"op{i % 4}" if i else None, 1.0) for i in range(21)] + [(21, "one", 1.0), (22, "two", 1.0), (23, "two", 2.0), (None, "op1", 1.0)], "well_api long, operator string, DEPTH double")
    got = {r.well_api: r for r in split.split_apportioned(wells).collect()}
    assert set(got) == set(range(24)) and got[21].split == "train" and {got[22].split, got[23].split} == {"train", "test"}


def test_formations_equal_a_range_join(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 2]), None if rng.random() < 0.03 else rng.uniform(0, 1000), rng.gauss(0, 1)) for _ in range(600)]
    tops = [(1, "a", None, 300.0), (1, "b", 250.0, 700.0), (1, "c", 600.0, None), (1, "none", 500.0, 500.0), (2, "all", None, None), (None, "n", 100.0, 200.0), (7, "other", None, None)]
    df = spark.createDataFrame(rows, "well_api long, DEPTH double, GR double")
    t = spark.createDataFrame(tops, "well_api long, formation string, top double, base double")
    want = []
    for w, d, v in rows:
        hits = [f for tw, f, a, b in tops if tw == w and d is not None and (a is None or d >= a) and (b is None or d < b) and not (a is not None and b is not None and a >= b)]
        want += [(w, d, v, f) for f in hits or [None]]
    for bucket in (10.0, 5000.0):
        got = formations.in_formations(df, t, bucket=bucket)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    z = formations.formation_scaled(got, "GR").collect()
    own = [r for r in z if r.well_api == 1 and r.formation == "b"]
    assert abs(sum(r.GR_z_formation for r in own)) < 1e-9 and len(z) == len(want)


def test_attributions_add_up(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.random(), rng.random(), rng.random(), i % 2) for i in range(40)], "id long, a double, b double, c double, flag int")
    model = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + 3 * F.col("c"))
    long = attribution.sampled_shapley(df, ["a", "b", "c"], model, ["id"], ["flag"], orders=6)
    by = long.groupBy("id").agg(F.sum("attribution").alias("s"), F.first("prediction").alias("p"), F.first("base").alias("b")).collect()
    assert len(by) == 40 and all(math.isclose(r.s, r.p - r.b, abs_tol=1e-12) for r in by)
    mean = attribution.background_row(df, ["a", "b", "c"])
    for r in long.join(df, "id").where("feature = 'c'").collect():
        assert math.isclose(r.attribution, 3 * (r.c - mean["c"]), abs_tol=1e-9)  # exact for an additive feature
    orders = attribution.feature_orders(5, 6)
    assert all(sorted(o) == list(range(5)) for o in orders) and all([4 - p for p in a] == b for a, b in zip(orders[::2], orders[1::2]))
    out = {(r.kind, r.name, r.part): r for r in attribution.summary(long, ["flag"], {"first": ["a", "b"], "none": ["zzz"]}).collect()}
    assert out["group", "first", None].features == 2 and out["group", "none", None].total == 0.0 and ("flag", "c", "flag") in out


def test_half_written_runs_are_skipped(spark):
    root = scratch_path(spark, "runs")
    with pytest.raises(ValueError):
        runs.load_run(spark, root)
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "well_api long, GR double")
    sp = spark.createDataFrame([(1, "train"), (2, "test")], "well_api long, split string")
    bad = spark.createDataFrame([("x.las", "empty file")], "file string, error string")
    first = runs.write_run(spark, root, {"features": df, "splits": sp}, failures=bad)
    runs.write_run(spark, root, {"features": df.limit(1)}, commit=False)
    assert runs.newest(spark, root)["run"] == first and runs.load_features(spark, root)[0].count() == 2
    second = runs.write_run(spark, root, {"features": df.drop("GR"), "splits": sp})
    assert runs.newest(spark, root)["run"] == second
    with pytest.raises(ValueError, match="GR"):
        runs.load_features(spark, root)
    assert runs.load_run(spark, root, ["failures"], run=first)["failures"].count() == 1
    with pytest.raises(ValueError, match="failures"):
        runs.load_run(spark, root, ["failures"])
    report = runs.run_report(spark, root).collect()
    assert {(r.run, r.table): (r.rows, r.n_failures, r.is_newest) for r in report}[first, "failures"] == (1, 1, False)
    assert all(r.is_newest == (r.run == second) for r in report)


def test_forest_scores_outliers_highest(spark):
    rng = random.Random(7)
    rows = [(1, i, rng.gauss(0, 1), rng.gauss(0, 1), None if i % 9 == 0 else rng.gauss(0, 1)) for i in range(800)] + [(1, 900 + i, 9.0 + i, -9.0, 9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "w long, i long, a double, b double, c double").repartition(3)
    forest = iforest.fit(df, ["a", "b", "c"], ["w", "i"])
    out = iforest.score(df, forest, ["a", "b", "c"])
    top = [r.i for r in out.orderBy(F.desc("isolation_score")).limit(5).collect()]
    assert sorted(top) == [900, 901, 902, 903, 904] and out.count() == 805 and out.columns == [*df.columns, "isolation_score", "is_outlier"]
    again = iforest.score(df.repartition(7), iforest.fit(df.repartition(7), ["a", "b", "c"], ["w", "i"]), ["a", "b", "c"])
    assert {r.i: r.isolation_score for r in out.collect()} == {r.i: r.isolation_score for r in again.collect()}
    empty = df.limit(0)
    assert iforest.score(df, iforest.fit(empty, ["a", "b", "c"], ["w", "i"]), ["a", "b", "c"]).where("isolation_score is null").count() == 805


def test_queries_do_not_need_the_optional_packages():
    """With a package of the training-data operators missing, the depth-series queries are all there."""
    code = ("import sys; sys.modules['zstandard'] = None; sys.path.insert(0, '.');"
            "import __spark_entry__ as e; from depthkit.plans import catalog;"
            "assert set(e.queries()) == set(catalog.queries()) and len(e.queries()) > 80 and set(e.oracle_sql()) == set(catalog.oracle_sql())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_scratch_tables_go_when_the_driver_ends(tmp_path):
    code = (f"from depthkit.session import *; s = get_spark(master='local[1]'); s.conf.set('spark.checkpoint.dir', '{tmp_path}');"
            f"d = cut_lineage(s.range(5), 'kept'); import os; assert d.count() == 5 and len(os.listdir('{tmp_path}')) == 1")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert not list(tmp_path.iterdir())
