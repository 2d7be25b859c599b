"""Per-query physical plan summary (run each query, then read its final
adaptive plan): shuffles, broadcasts, windows, partial limits, scans.

    python tools/plan_report.py <sf_dir> [names...]   # prints a markdown table
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from batchwright.session import build_session  # noqa: E402


def summary(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    return {
        "shuffles": len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|"
                                   r"\bExchange RoundRobin|\bExchange SinglePartition|\bExchange \w+\(", final)),
        "reused": final.count("ReusedExchange") + final.count("ReusedQueryStage"),
        "broadcasts": final.count("BroadcastExchange"),
        "windows": final.count("Window ["),
        "partial_limits": final.count("WindowGroupLimit"),
        "scans": final.count("FileScan parquet"),
        "python": any(n in final for n in ("EvalPython", "InPandas", "PythonUDF")),
    }


def hot_keys(spark, sf_dir):
    """The ordered operators with a row bound so low that many keys are cut."""
    from batchwright.operators import lifecycle as LC
    from batchwright.operators.asof import as_of_join
    from batchwright.plans import standins as S
    from batchwright.sources.tables import load
    events, orders = load(spark, sf_dir, "events"), load(spark, sf_dir, "orders")
    yield "variable_as_of, max_rows=5", as_of_join(
        S.variable_lookups(events), S.project_variables(orders), ["project_id", "name"], "at", "effective_at",
        ["value", "version"], tie="seq", max_rows=5)
    yield "transition_audit, max_rows=50", LC.transition_counts(S.instance_events(events), max_rows=50)
    yield "published_pointer, max_rows=5", LC.published_pointer(S.task_versions(orders), S.rollbacks(orders), max_rows=5)
    yield "peak_running, max_rows=500", LC.peak_running(S.runs(events), max_rows=500)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:]
    spark = build_session()
    from batchwright.plans.registry import QUERIES
    cols = ["shuffles", "reused", "broadcasts", "windows", "partial_limits", "scans", "python"]
    print("| query | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))

    def line(name, df):
        df.collect()  # fixes the final adaptive plan of this DataFrame
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)

    for name, fn in QUERIES.items():
        if not names or name in names:
            line(name, fn(spark, sf_dir))
    for name, df in hot_keys(spark, sf_dir):
        if not names or name in names:
            line(name, df)
    spark.stop()


if __name__ == "__main__":
    main()
