"""The operators' queries that have SQL, against DuckDB."""

import pytest

from batchwright.llm.queries import ORACLES, QUERIES
from tools.oracle_check import duck, rows_of

SMALL = "/root/testdata/sf0.001"


def test_queries_of_every_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == [*range(1, 14)] and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op4_chat_rotation", "op9_exact_topk"}))  # these two: in their own tests
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck(SMALL).execute(ORACLES[name])
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    assert got_cols == want_cols and got == want
