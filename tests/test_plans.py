"""Plan-shape checks: windows per block for the feature select, no cartesian products, no Python UDFs."""

import re

import __spark_entry__ as E
from depthkit.operators.clean import clip_ranges
from depthkit.operators.features import engineer_features
from depthkit.plans import catalog
from depthkit.plans.common import E as events

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_windows_are_per_block(spark):
    """Feature windows of the flagship are partitioned by (well, block); only the small tables of bucket
    and block summaries are by well."""
    p = plan(E.queries()["well_features"](spark, SF))
    specs = re.findall(r"\[([^\[\]]*)\], \[(_idx|DEPTH)#", p)
    assert {"_idx", "DEPTH"} <= {order for _, order in specs}
    assert all("_blk#" in keys for keys, order in specs if order == "_idx")
    assert all("_bkt#" in keys for keys, order in specs if order == "DEPTH")


def test_unsplit_plan_has_a_single_exchange(spark):
    df = clip_ranges(events(spark, SF).select("well_api", "DEPTH", "GR"))
    p = plan(engineer_features(df, "GR", skew="off"))
    assert p.count("Exchange hashpartitioning") == 1


def test_no_cartesian_or_python(spark):
    for name, fn in catalog.queries().items():
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_scan_prunes_columns(spark):
    p = E.queries()["qc_target_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    m = re.search(r"ReadSchema: struct<([^>]*)>", p)
    assert m and "props" not in m.group(1) and "event_type" not in m.group(1), p
