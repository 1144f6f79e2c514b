"""Nearest donors against brute force: nulls, ties, many nodes, and no pairing of a well's rows."""

import math
import random
import re

import pytest

from depthkit.operators import knn

CURVES = ["GR", "RHOB", "NPHI", "RT"]


def log(spark, n=1500, seed=6, grid=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        well = rng.choice([None, 1, 2, 2, 2, 3])
        value = (lambda s: float(rng.randint(0, 4)) * s) if grid else (lambda s: rng.gauss(0, s))
        row = [value(1.0), value(2.0), value(5.0), value(0.5)]
        row = [None if rng.random() < (0.6 if well == 3 and c == 2 else 0.15) else v for c, v in enumerate(row)]
        rows.append((well, float(i // 2), i, *row))
    rows += [(9, float(i), i, None if i == 3 else 1.0, 2.0, 3.0, 4.0) for i in range(9)]  # too few donors
    rows += [(8, float(i), i, None, None, None, None) for i in range(30)]
    return spark.createDataFrame(rows, "well_api long, DEPTH double, src_row long, " + ", ".join(f"{c} double" for c in CURVES)), rows


def brute(rows, target, k=5):
    """{(well, src_row): mean of the donors} by comparing every missing row with every donor."""
    at, others = 3 + CURVES.index(target), [3 + i for i, c in enumerate(CURVES) if c != target]
    out = {}
    for well in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == well]
        use = [c for c in others if sum(r[c] is not None for r in mine) > len(mine) * 0.5]
        z = {}
        for c in use:
            known = [r[c] for r in mine if r[c] is not None]
            m = sum(known) / len(known)
            s = math.sqrt(sum((v - m) ** 2 for v in known) / len(known)) or 1.0
            for r in mine:
                z[r[2], c] = None if r[c] is None else (r[c] - m) / s
        donors = [r for r in mine if r[at] is not None and any(z[r[2], c] is not None for c in use)]
        if len(donors) <= 10:
            continue
        for q in mine:
            if q[at] is None:
                near = []
                for d in donors:
                    both = [c for c in use if z[q[2], c] is not None and z[d[2], c] is not None]
                    if both:
                        near.append((round(sum((z[q[2], c] - z[d[2], c]) ** 2 for c in both) * len(use) / len(both), 9), d[1], d[2], d[at]))
                if near:
                    best = sorted(near)[:max(1, min(k, len(donors) // 2))]
                    out[well, q[2]] = sum(b[3] for b in best) / len(best)
    return out


@pytest.mark.parametrize("fan,grid", [(64, False), (4, False), (4, True)])
def test_donors_equal_brute_force(spark, monkeypatch, fan, grid):
    monkeypatch.setattr(knn, "FAN", fan)
    df, rows = log(spark, grid=grid)
    got = {(r.well_api, r.src_row): r for r in knn.knn_impute(df, ["GR", "NPHI"], CURVES, tie="src_row").collect()}
    assert len(got) == len(rows)
    for target in ("GR", "NPHI"):
        want = brute(rows, target)
        for r in rows:
            v, have = r[3 + CURVES.index(target)], got[r[0], r[2]][target]
            v = want.get((r[0], r[2])) if v is None else v
            assert (have is None) == (v is None) and (v is None or math.isclose(have, v, rel_tol=1e-9, abs_tol=1e-9)), (target, r, have, v)


def test_rows_are_not_paired_within_a_well(spark):
    """Donors join by their node, not by the well; only tables of nodes meet queries by well."""
    df, _ = log(spark)
    base = df.withColumn("_id", df.src_row)
    plan = knn.nearest_donors(base, "GR", ["RHOB", "NPHI", "RT"])._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join Inner, (.*)", plan)
    assert joins and all("_node" in j or "_parent" in j for j in joins[:1])  # the last join, to the donors
    assert "CartesianProduct" not in plan


def test_empty_table(spark):
    df, _ = log(spark)
    assert knn.knn_impute(df.limit(0), ["GR"], CURVES).count() == 0


@pytest.mark.parametrize("small,fan", [(0, 4), (300, 64)])
def test_large_and_small_wells_equal_brute_force(spark, monkeypatch, small, fan):
    """Wells above ``SMALL`` rows go by the tree, others are filled in one task; null wells are either."""
    monkeypatch.setattr(knn, "FAN", fan)
    monkeypatch.setattr(knn, "SMALL", small)
    df, rows = log(spark, n=900, grid=True)
    got = {(r.well_api, r.src_row): r for r in knn.knn_impute(df, ["GR", "NPHI"], CURVES, tie="src_row").collect()}
    assert len(got) == len(rows)
    for target in ("GR", "NPHI"):
        want = brute(rows, target)
        for r in rows:
            v, have = r[3 + CURVES.index(target)], got[r[0], r[2]][target]
            v = want.get((r[0], r[2])) if v is None else v
            assert (have is None) == (v is None) and (v is None or math.isclose(have, v, rel_tol=1e-9, abs_tol=1e-9)), (target, r, have, v)


def test_pairs_are_not_shuffled(spark):
    """Small wells have no join at all; a leaf's donors meet a query in one row that keeps at most k of them (F8)."""
    df, _ = log(spark)
    plan = knn.knn_impute(df, ["GR"], CURVES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    plan = knn.nearest_donors(df.withColumn("_id", df.src_row), "GR", ["RHOB", "NPHI", "RT"])._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan[:plan.index("Join Inner")]
