"""Every registered query equals its DuckDB oracle (sf0.001): rows, columns, values."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from tillstar.plans import catalog, oracle  # noqa: E402

KEYS = sorted(catalog.queries())  # optional queries are tested beside their modules


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(catalog.queries()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["country", "n_sales"]
    assert 0 < df.count() <= 10


@pytest.mark.parametrize("name", KEYS)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)
