"""Physical-plan properties the scale design depends on."""

import pytest

from conftest import SMALL

import __spark_entry__ as E
from batchwright.plans.registry import QUERIES

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonUDF", "MapPartitions", "SerializeFromObject")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_any_query(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert not [n for n in PYTHON_NODES if n in plan]


def test_company_dim_limits_before_shuffle_and_prunes_columns(spark):
    plan = _plan(E.queries()["company_dim"](spark, SMALL))
    assert plan.count("WindowGroupLimit") >= 4  # partial + final, for both dedups
    df = E.queries()["company_dim"](spark, SMALL)
    formatted = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert ("ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,"
            "l_returnflag:string,l_shipdate:timestamp_ntz>") in formatted


def _final(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_as_of_plans(spark):
    """One window and one scan of each input; with hot keys two, and no join of the inputs."""
    from batchwright.operators.asof import as_of_join
    from batchwright.plans import standins as S
    from batchwright.sources.tables import load
    lookups, variables = S.variable_lookups(load(spark, SMALL, "events")), S.project_variables(load(spark, SMALL, "orders"))
    plans = {}
    for max_rows in (2_000_000, 5):
        plans[max_rows] = _final(as_of_join(lookups, variables, ["project_id", "name"], "at", "effective_at",
                                            ["value", "version"], tie="seq", max_rows=max_rows))
    plain, hot = plans[2_000_000], plans[5]
    assert plain.count("Window [") == 1 and plain.count("FileScan parquet") == 2 and "Join" not in plain
    assert hot.count("events.parquet") <= 2 and hot.count("orders.parquet") <= 2 and "SortMergeJoin" not in hot


def test_one_business_date_reads_one_partition(spark):
    df = E.queries()["pruned_day"](spark, SMALL)
    formatted = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(dt" in formatted and "= 20240115)]" in formatted


def test_unresolved_shuffles_no_text(spark):
    plan = _plan(E.queries()["unresolved_vars"](spark, SMALL))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("Window [") == 1
