"""Registered attribution queries (M9, A22): sampled Shapley values, stored as a long table and summed up from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthkit.operators import attribution as AT
from depthkit.operators import models as MO
from depthkit.operators import split as SP
from depthkit.operators.features import lithology_exprs
from depthkit.plans.common import L, R, register, round_doubles, sql
from depthkit.plans.q_models import SMALL_RF, model_data
from depthkit.session import scratch_path
from depthkit.sinks.writers import write_table

FEATURES = ["GR", "RHOB", "RT", "PE"]
FLAGS = ["is_shale", "is_resistive"]
ORDERS = 6


def formula(df):
    """A curve composite as the model: organic indicator plus a product of two curves."""
    return df.withColumn("prediction", F.col("GR") * F.log10(F.col("RT") + 1) + F.col("RHOB") * F.col("PE"))


def _formula_sql() -> str:
    f = lambda v: f"{v['GR']} * log10({v['RT']} + 1) + {v['RHOB']} * {v['PE']}"
    orders, parts = AT.feature_orders(len(FEATURES), ORDERS), []
    for place in orders:
        for i, c in enumerate(FEATURES):
            with_ = lambda k: f({x: (f"s.{x}" if place[j] < k else f"b.{x}") for j, x in enumerate(FEATURES)})
            parts.append(f"SELECT k, is_shale, is_resistive, '{c}' AS feature, ({with_(place[i] + 1)}) - ({with_(place[i])}) AS a FROM s CROSS JOIN b")
    whole = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
    known = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
    head = f""", src AS (SELECT * FROM l WHERE {known}),
s AS MATERIALIZED (SELECT md5(CAST(well_api AS VARCHAR) || '|' || CAST(CAST(DEPTH AS BIGINT) AS VARCHAR) || ':42') AS k, {", ".join(FEATURES)}, (GR >= 80)::INT AS is_shale, (RT >= 10)::INT AS is_resistive FROM src ORDER BY 1 LIMIT 2000),
b AS MATERIALIZED (SELECT {whole} FROM src),
steps AS ({" UNION ALL ".join(parts)}),
long AS MATERIALIZED (SELECT k, feature, any_value(is_shale) AS is_shale, any_value(is_resistive) AS is_resistive, avg(a) AS attribution FROM steps GROUP BY 1, 2),
per AS (SELECT feature, avg(abs(attribution)) AS total FROM long GROUP BY 1)"""
    groups = " UNION ALL ".join(
        f"SELECT 'group', '{g}', NULL, count(*), coalesce(sum(total), 0.0) FROM per WHERE " + " OR ".join(f"contains(feature, '{p}')" for p in parts_)
        for g, parts_ in AT.ATTRIBUTION_GROUPS.items())
    flags = " UNION ALL ".join(f"SELECT 'flag', feature, '{f_}', 1, avg(abs(attribution)) FILTER (WHERE {f_} = 1) FROM long GROUP BY feature" for f_ in FLAGS)
    return sql(head + f", o(kind, name, part, features, total) AS (SELECT 'feature', feature, NULL, 1, total FROM per UNION ALL {groups} UNION ALL {flags}) "
               f"SELECT kind, name, part, CAST(features AS BIGINT) AS features, {R('total')} AS total FROM o")


@register("shapley_formula", _formula_sql())
def shapley_formula(spark, sf):
    """2,000 sampled rows of the log (the sampling operator's limit), all orders in one job; summaries from the stored table."""
    df = L(spark, sf).drop("operator_id")
    flags = {k: v for k, v in lithology_exprs(df.columns).items() if k in FLAGS}
    df = df.withColumns(flags).filter(" and ".join(f"{c} is not null" for c in FEATURES)).withColumn("_d", F.col("DEPTH").cast("long"))
    rows = SP.stable_sample(df, ["well_api", "_d"], 2000)
    path = scratch_path(spark, "attribution")
    write_table(AT.sampled_shapley(rows, FEATURES, formula, ["well_api", "DEPTH"], FLAGS, AT.background_row(df, FEATURES), ORDERS), path)
    return round_doubles(AT.summary(spark.read.parquet(path), FLAGS))


@register("shapley_forest")
def shapley_forest(spark, sf):
    """A forest on all features; 200 sampled test rows, two antithetic orders of all features, scored in one job."""
    train, test, feats = model_data(spark, sf)
    m = MO.fit(train, feats, "random_forest", **SMALL_RF)
    flags = [f for f in feats if f.startswith("is_")]
    rows = SP.stable_sample(test.withColumn("_d", F.col("DEPTH").cast("long")).withColumns({f"flag_{f}": F.col(f) for f in flags}), ["well_api", "_d"], 200)
    predict = lambda d: m.transform(d.drop("prediction")).drop("features")
    path = scratch_path(spark, "attribution")
    write_table(AT.sampled_shapley(rows, feats, predict, ["well_api", "DEPTH"], [f"flag_{f}" for f in flags], orders=2), path)
    return round_doubles(AT.summary(spark.read.parquet(path), [f"flag_{f}" for f in flags]))
