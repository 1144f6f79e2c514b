"""Block carry and value-count quantiles: hard series, ties, plan shapes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from depthkit.functions.quantiles import group_quantiles
from depthkit.operators import explore, features, impute, resample
from depthkit.operators.carry import asof_neighbours, neighbours


def hard(spark, n=900, seed=4):
    """Null wells, null and tied depths, a well without values, one hot well, gaps over many blocks."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        well = rng.choice([None, 1, 2, 3, 3, 3, 4])
        depth = None if rng.random() < 0.05 else float(rng.randint(0, 150))
        value = None if well == 4 or (depth is not None and 40 < depth < 110 and well == 3) or rng.random() < 0.3 else rng.uniform(0, 100)
        rows.append((well, i, depth, value))
    return spark.createDataFrame(rows, "well_api long, src_row long, DEPTH double, GR double"), rows


def ordered(rows):
    wells = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        wells.setdefault(r[0], []).append(r)
    return wells


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_neighbours_equal_brute_force(spark, block):
    df, rows = hard(spark)
    got = {r.src_row: r for r in neighbours(df, ["GR"], tie="src_row", block_rows=block).collect()}
    assert len(got) == len(rows)
    for series in ordered(rows).values():
        for i, r in enumerate(series):
            g = got[r[1]]
            up = next(((j, series[j][2], series[j][3]) for j in range(i, -1, -1) if series[j][3] is not None), None)
            down = next(((j, series[j][2], series[j][3]) for j in range(i, len(series)) if series[j][3] is not None), None)
            assert (g._idx, g._n) == (i, len(series))
            assert (g["_prev_GR"] and tuple(g["_prev_GR"])) == up and (g["_next_GR"] and tuple(g["_next_GR"])) == down


def test_neighbours_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, 5.0, None)] * 6 + [(1, 1, 5.0, 2.0)] * 6, "well_api long, src_row long, DEPTH double, GR double")
    out = neighbours(df, ["GR"], tie="src_row", block_rows=2).collect()
    assert sorted(r._idx for r in out) == list(range(12)) and {r["_next_GR"].i for r in out if r.GR is None} == {6}
    assert neighbours(df.limit(0), ["GR"]).count() == 0 and impute.interpolate_index(df.limit(0), ["GR"]).count() == 0


@pytest.mark.parametrize("block", [11, 10_000])
def test_asof_neighbours_equal_brute_force(spark, block):
    df, rows = hard(spark)
    probes = [(w, None, float(d) / 2, None) for w in (None, 1, 2, 3, 4, 5) for d in range(-3, 310, 7)]
    both = df.select("well_api", "src_row", "DEPTH", "GR", F.lit(False).alias("p")).unionByName(
        spark.createDataFrame(probes, "well_api long, src_row long, DEPTH double, GR double").withColumn("p", F.lit(True)))
    got = {(r.well_api, r.DEPTH): r for r in asof_neighbours(both.where("DEPTH is not null"), ["GR"], "p", "src_row", block_rows=block).collect()}
    assert len(got) == len(probes)
    for w, _, d, _ in probes:
        known = {}
        for r in sorted(rows, key=lambda r: r[1]):
            if r[0] == w and r[2] is not None and r[3] is not None:
                known.setdefault(r[2], r[3])
        up, down = max((k for k in known if k <= d), default=None), min((k for k in known if k >= d), default=None)
        g = got[w, d]
        assert (g["_prev_GR"] and tuple(g["_prev_GR"])) == (None if up is None else (up, known[up]))
        assert (g["_next_GR"] and tuple(g["_next_GR"])) == (None if down is None else (down, known[down]))
        assert (g["_span_GR"].lo, g["_span_GR"].hi) == (min(known, default=None), max(known, default=None))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_windows_are_by_block(spark):
    """No window over rows is partitioned by the well alone."""
    df, _ = hard(spark)
    jobs = {
        "fill": impute.fill_forward_backward(df, ["GR"]), "interpolate": impute.interpolate_index(df, ["GR"]), "gap_runs": explore.gap_runs(df, "GR"),
        "gap_policy": explore.gap_policy(df, "GR"), "resample": resample.resample(df, ["GR"]), "smoothing": explore.smoothing(df, "GR"),
        "rolling": features.rolling_features(df, "GR", [5]), "gradients": features.gradient_features(df, "GR"), "autocorr": explore.autocorrelation(df, "GR"),
    }
    for name, job in jobs.items():
        for keys, order in re.findall(r"windowspecdefinition\(([a-zA-Z_]+)#\d+L?, ([a-zA-Z_]+)#", plan(job)):
            assert keys != "well_api" or order in ("_blk", "_bkt", "_b"), (name, keys, order)


def test_far_outlier_does_not_make_an_array(spark):
    """The grid of a series with one far depth is made from many rows of bounded size."""
    df = spark.createDataFrame([(1, i, float(i), float(i)) for i in range(10)] + [(1, 10, 3e5, 1.0)], "well_api long, src_row long, DEPTH double, GR double")
    grid = resample.depth_grid(df, block=1000)
    assert grid.count() == 300_001 and grid.agg(F.countDistinct("grid_index")).first()[0] == 300_001
    assert "sequence((_b" in plan(grid).replace("#", "").replace("L", "") or "_b" in plan(grid)
    out = resample.resample(df, ["GR"], grid_block=1000, block_rows=5000).where("DEPTH = 200000").first()
    assert math.isclose(out.GR, 9 + (1 - 9) * (200_000 - 9) / (300_000 - 9))


def test_quantiles_of_hard_groups(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    values = {None: [3.0], 1: [None, None], 2: [5.0] * 4000 + [7.0] * 3000, 3: rng.lognormal(0, 40, 3000).tolist(), 4: (-rng.random(500)).tolist() + [0.0, -0.0] * 9,
              5: (1e9 + 1e-4 * rng.random(2000)).tolist(), 6: [float("-inf"), 1.0, 2.0, float("inf")], 7: [1.0, float("nan")]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g long, v double").repartition(5)
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", [0, 0.01, 0.25, 0.5, 0.9, 1], list("abcdef"), count_name="n").collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        known = [v for v in vs if v is not None]
        assert got[k].n == len(known)
        for q, name in zip([0, 0.01, 0.25, 0.5, 0.9, 1], "abcdef"):
            want = None
            if known:
                order = sorted(known, key=lambda v: (math.isnan(v), v))
                h = (len(order) - 1) * q
                lo, hi = order[math.floor(h)], order[math.ceil(h)]
                want = lo if h == math.floor(h) else lo + (h - math.floor(h)) * (hi - lo)
            have = got[k][name]
            assert have == want or (have is not None and want is not None and (math.isnan(have) and math.isnan(want) or math.isclose(have, want, rel_tol=1e-12))), (k, q, have, want)
    assert group_quantiles(df.where("g = 99"), ["g"], "v", [0.5]).count() == 0
    assert group_quantiles(df, [], "v", [0.5], ["m"]).count() == 1


def test_tied_values_are_one_run(spark):
    """However many rows tie, each task sends one row for a value, and one row is ranked."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") % 4).cast("double").alias("v"))
    runs = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    assert runs.count() == 4
    p = plan(group_quantiles(df, ["g"], "v", [0.5]))
    assert "percentile" not in p and p.count("partial_count(1)") >= 1
    assert group_quantiles(df, ["g"], "v", [0.5, 0.9], ["a", "b"]).first()[1:] == (1.5, 3.0)


def test_rows_of_empty_and_null_wells_stay(spark):
    rows = [(w, float(i), None if w == 2 else float(i * i % 17)) for w in (1, 2, None) for i in range(20)]
    df = spark.createDataFrame(rows, "well_api long, DEPTH double, GR double")
    flags = explore.mad_iqr_flags(df, "GR")
    assert flags.count() == 60 and flags.where("well_api = 2 and (mad_flag or iqr_flag)").count() == 0
    z = explore.zscores(df, "GR")
    assert z.count() == 60 and z.where("well_api is null and GR_z_well is not null").count() == 20
    filled = impute.impute_median(df.withColumn("GR", F.when(F.col("DEPTH") > 3, F.col("GR"))), ["GR"])
    assert filled.count() == 60 and filled.where("GR is null").count() == 20


def test_series_of_one_bucket_are_shuffled_once(spark):
    """Nothing is carried, so there is one window shuffle and no join of a summary, and the values are those of the carry."""
    rows = [(None if i % 9 == 0 else i % 3, i, None if i % 11 == 0 else float(i // 2), None if i % 4 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "well_api long, src_row long, DEPTH double, GR double")
    whole, cut = (neighbours(df, ["GR"], tie="src_row", block_rows=n) for n in (1_000_000, 16))
    cols = ["well_api", "src_row", "_idx", "_n", "_prev_GR", "_next_GR"]
    assert sorted(map(repr, whole.select(cols).collect())) == sorted(map(repr, cut.select(cols).collect()))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_off" not in plan


def test_grid_is_dealt_to_a_fixed_number_of_tasks(spark):
    """Adaptive execution must not put the blocks, and so all grid points, in one task."""
    from depthkit.operators.resample import depth_grid
    df = spark.createDataFrame([(w, w, float(d)) for w in range(40) for d in (0, 500)], "well_api long, src_row long, DEPTH double")
    assert depth_grid(df, 1.0, block=100).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
