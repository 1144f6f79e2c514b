"""The blocked (hot-group) feature plan equals the plain plan row for row."""

from pyspark.sql import functions as F

from depthkit.operators.clean import clip_ranges
from depthkit.operators.features import engineer_features
from depthkit.plans.common import E

SF = "/root/testdata/sf0.001"


def test_blocked_equals_plain(spark):
    df = clip_ranges(E(spark, SF).select("well_api", "DEPTH", "GR"))
    plain = engineer_features(df, "GR", skew="off")
    blocked = engineer_features(df, "GR", block_rows=24)
    assert plain.columns == blocked.columns
    a = sorted(plain.collect(), key=lambda r: (r["well_api"], r["DEPTH"]))
    b = sorted(blocked.collect(), key=lambda r: (r["well_api"], r["DEPTH"]))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c in plain.columns:
            u, v = x[c], y[c]
            if u is None or v is None:
                assert u is None and v is None, (c, x["well_api"], x["DEPTH"], u, v)
            else:
                assert abs(u - v) <= 1e-9 * max(1.0, abs(u)), (c, x["well_api"], x["DEPTH"], u, v)
    # a single task never holds more than block + 2 * halo rows of a well
    from depthkit.operators.blocked import series_index, with_blocks
    idx, _ = series_index(df, bucket_rows=24)
    sizes = with_blocks(idx, 24, 16).groupBy("well_api", "_blk").count().agg(F.max("count")).first()[0]
    assert sizes <= 24 + 2 * 16


def test_blocked_sequences_equal_plain(spark):
    from depthkit.operators.sequences import sequences
    from depthkit.plans.common import L
    df = L(spark, SF).drop("operator_id")
    feats = ["RHOB", "NPHI", "RT", "PE"]
    a = sequences(df, feats, "GR", 10, 2, skew="off").orderBy("well_api", "depth").collect()
    b = sequences(df, feats, "GR", 10, 2, skew="on", block_rows=40).orderBy("well_api", "depth").collect()
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x.asDict() == y.asDict()


def odd_series(spark):
    """Null wells, null depths, tied depths, and one well with a far outlier."""
    rows = [(None if i % 11 == 0 else i % 3, i, None if i % 13 == 0 else float(i // 2), None if i % 7 == 0 else float(i * 37 % 101)) for i in range(600)]
    rows += [(9, 1000 + i, 1000 + i / 1000, float(i % 17)) for i in range(2000)] + [(9, 5000, 1e9, 3.0)]
    return spark.createDataFrame(rows, "well_api long, src_row long, DEPTH double, GR double")


def test_blocked_keeps_null_and_tied_rows(spark):
    df = odd_series(spark)
    plain = engineer_features(df, "GR", skew="off", tie="src_row")
    blocked = engineer_features(df, "GR", block_rows=64, tie="src_row")
    a, b = ({r["src_row"]: r for r in x.collect()} for x in (plain, blocked))
    assert a.keys() == b.keys() and len(a) == df.count()
    for k in a:
        for c in plain.columns:
            u, v = a[k][c], b[k][c]
            assert u == v or (u is not None and v is not None and abs(u - v) <= 1e-9 * max(1.0, abs(u))), (k, c, u, v)


def test_buckets_are_bounded_despite_an_outlier(spark):
    from depthkit.operators.blocked import series_buckets, series_index
    j, _ = series_buckets(odd_series(spark), bucket_rows=100)
    assert j.groupBy("well_api", "_bkt").count().agg(F.max("count")).first()[0] <= 200
    idx, _ = series_index(odd_series(spark), bucket_rows=100, tie="src_row")
    rows = idx.filter("well_api = 9").orderBy("_idx").collect()
    assert [r["_idx"] for r in rows] == list(range(2001)) and rows[-1]["DEPTH"] == 1e9
    assert [r["DEPTH"] for r in rows] == sorted(r["DEPTH"] for r in rows)


def test_buckets_follow_a_series_own_rows(spark):
    """One hot well must not cut the small ones as finely as itself."""
    from depthkit.operators.blocked import series_buckets
    rows = [(0, i, float(i * 7919 % 20011)) for i in range(20_000)] + [(w, w * 1000 + i, float(i)) for w in range(1, 6) for i in range(200)]
    df = spark.createDataFrame(rows, "well_api long, src_row long, DEPTH double")
    j, _ = series_buckets(df, bucket_rows=50)  # 400 buckets of the hot well: two levels of borders
    sizes = {(r["well_api"], r["_bkt"]): r["count"] for r in j.groupBy("well_api", "_bkt").count().collect()}
    assert max(sizes.values()) <= 150
    assert all(sum(w == well for w, _ in sizes) <= 12 for well in range(1, 6))
    ends = sorted((r["_bkt"], r["lo"], r["hi"]) for r in j.filter("well_api = 0").groupBy("_bkt").agg(F.min("DEPTH").alias("lo"), F.max("DEPTH").alias("hi")).collect())
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def test_sequences_are_numbered_before_they_are_built(spark):
    """No shuffle above the frames: rows with sequences are not shuffled."""
    from depthkit.operators.sequences import sequences
    from depthkit.plans.common import L
    plan = sequences(L(spark, SF), ["RHOB", "PE"], "GR", 10, 1)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("collect_list")]
    assert "Exchange" not in above and "Join" not in above


def test_only_input_columns_are_shuffled(spark):
    """Rolling features are computed above the last shuffle."""
    df = odd_series(spark)
    plan = engineer_features(df, "GR", block_rows=64, tie="src_row")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[:plan.index("Join LeftOuter")], plan[plan.index("Join LeftOuter"):]
    assert "GR_roll_mean_20" in above and "GR_roll_" not in below
