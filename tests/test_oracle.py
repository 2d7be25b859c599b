"""Every registered query against its DuckDB oracle (the driver's check, on sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from batchwright.plans.registry import QUERIES as BASE
from tools.oracle_check import duck, rows_of

ORACLES = E.oracle_sql()
QUERIES = {k: v for k, v in E.queries().items() if k in BASE}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLES[name])
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    assert got_cols == want_cols
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["key_no", "company_id", "company_name"]
    assert len(df.columns) == 28
    assert df.count() >= 0
