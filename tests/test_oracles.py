"""Every registered query against its DuckDB oracle at sf0.001 (rows, columns, values)."""

import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as E  # noqa: E402
from depthkit.plans import catalog  # noqa: E402
from oracle_check import TABLES, canon  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    gc, gr = canon(got)
    wc, wr = canon(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    """Model jobs: there are rows, no column is all NULL but for spreads of single values, and scores are finite."""
    rows = E.queries()[name](spark, SF).toPandas()
    assert len(rows) > 0
    for c in rows.columns:
        if rows[c].dtype.kind == "f":
            assert np.isfinite(rows[c].dropna()).all(), c
            assert not c.startswith("r2") or (rows[c].dropna() <= 1).all(), c


def test_optional_queries_are_registered():
    assert set(catalog.queries()) <= set(E.queries()) and set(catalog.oracle_sql()) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
