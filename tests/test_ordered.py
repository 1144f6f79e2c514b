"""Rolling statistics and fills in numpy against plain loops and Spark's own windows, over batches of few rows."""

import math
import random

import numpy as np
import pytest

from depthkit.operators import blocked, impute, models, ordered
from depthkit.operators.features import engineer_features

SCHEMA = "well_api long, DEPTH double, GR double, RHOB double, NPHI double"


def rows(n=230, seed=3):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, None, 1.0, 2.0, math.nan, rng.uniform(-5, 5)])
    out = [(w, float(d) if d % 17 else None, value(), value(), value()) for w in (1, 2, None) for d in range(n)]
    return [*out, (4, 1.0, None, None, None), (4, 2.0, None, None, None), (5, 1.0, 3.0, 1.0, 1.0)]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def text(df):
    return sorted(map(repr, df.collect()))


def test_rolling_equals_spark_windows(small_batches, monkeypatch):
    df = small_batches.createDataFrame(rows(), SCHEMA).drop("RHOB", "NPHI")
    got = engineer_features(df, "GR", block_rows=50)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(blocked, "fits_arrow", lambda df: False)
    assert text(got) == text(engineer_features(df, "GR", block_rows=50))


def test_fills_equal_the_carry(small_batches, monkeypatch):
    monkeypatch.setattr(ordered, "_SLICE", 20)
    family = {"GR": "rolling", "RHOB": "gradient", "NPHI": "ratio"}.get
    df = small_batches.createDataFrame([r for r in rows() if r[1] is not None], SCHEMA)
    fill = lambda: impute.impute_by_family(df, ["GR", "RHOB", "NPHI"], family=family)
    got = fill()
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    got = text(got)
    monkeypatch.setattr(impute, "FILL_ROWS", 1)  # the carry of buckets, for series that no task should hold
    assert text(fill()) == got


def test_models_of_one_table_share_its_vectors(spark, monkeypatch):
    """Folds, candidates and points of the curve are fitted on vectors assembled once; scores come in order."""
    rng = random.Random(1)
    data = [(i % 12, float(i), rng.random(), rng.random()) for i in range(600)]
    df = spark.createDataFrame([(w, d, a, b, 10 * a) for w, d, a, b in data], "well_api long, DEPTH double, a double, b double, label double")
    made = []
    monkeypatch.setattr(models, "_assembler", lambda f, make=models._assembler: made.append(f) or make(f))
    params = [{"numTrees": 2, "maxDepth": 1}, {"numTrees": 3, "maxDepth": 5}]
    best, table = models.search(df, ["a", "b"], params=params, folds=3)
    got = [(r.candidate, r.cv_mean) for r in table.orderBy("candidate").collect()]
    assert [c for c, _ in got] == [0, 1] and got[1][1] > max(got[0][1], 0.9) and best.stages[-1].getNumTrees == 3
    assert best.transform(df).count() == 600
    curve = models.learning_curve(df, ["a", "b"], sizes=[0.5, 1.0], splits=2, numTrees=3, maxDepth=5).collect()
    assert [(r.split, r.train_fraction) for r in curve] == [(0, 0.5), (0, 1.0), (1, 0.5), (1, 1.0)]
    assert all(0.8 < r.test_r2 <= 1 for r in curve) and made.count(["a", "b"]) >= 2 and len(made) <= 3
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_small_series_are_numbered_by_one_shuffle(spark):
    df = spark.createDataFrame(rows(40), SCHEMA)
    got, _ = blocked.series_index(df, bucket_rows=1000)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    cut, _ = blocked.series_index(df, bucket_rows=7)
    assert text(got.select(sorted(got.columns))) == text(cut.select(sorted(cut.columns)))


def test_tables_of_a_run_are_made_from_written_ones(spark, tmp_path):
    from depthkit.sinks import runs
    df = spark.createDataFrame([(1,), (2,)], "a long")
    seen = []
    runs.write_run(spark, str(tmp_path), {"one": df, "two": lambda done: seen.append(done["one"].inputFiles()) or done["one"].selectExpr("a + 1 as b")}, kind="k")
    assert sorted(r.b for r in runs.load_run(spark, str(tmp_path), ["two"], "k")["two"].collect()) == [2, 3] and seen[0]
