"""Rules and catalogs as tables, and runs that overlap ranges, against plain loops."""

import datetime as dt
import random
import re

import pytest

from batchwright.operators.overlap import concurrency_by_minute, running_between
from batchwright.operators.rules import literal_start, match_by_catalog, policy_by_rules

BASE = dt.datetime(2024, 1, 1)


def test_rules_of_many_lengths_deny_wins(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(n))
    rules = [(rng.choice(["t1", "t2", None]), rng.choice(["allow", "allow", "deny"]), rng.choice(["key", "prefix"]), word(rng.randrange(1, 6)))
             for _ in range(120)] + [("t3", "allow", "prefix", ""), ("t1", "deny", "prefix", None)]
    conf = [(i, rng.choice(["t1", "t2", "t3", None]), rng.choice([None, word(rng.randrange(0, 8))])) for i in range(300)]
    out = policy_by_rules(spark.createDataFrame(conf, "id long, tenant string, key string"),
                          spark.createDataFrame(rules, "tenant string, effect string, match string, pattern string"), by=["tenant"])
    want = {}
    for i, t, k in conf:
        hit = {e for rt, e, m, p in rules if rt == t and k is not None and p is not None and (k == p if m == "key" else k.startswith(p))}
        want[i] = "blacklisted" if "deny" in hit else "accepted" if hit else "not in whitelist"
    got = out.collect()
    assert {r["id"]: r["verdict"] for r in got} == want and len(got) == 300 and out.columns == ["id", "tenant", "key", "verdict"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


def test_literal_starts(spark):
    cases = {r"^\$\{dt\}$": "${dt}", r"^\$\{dt-([1-9][0-9]*|0)\}$": "${dt-", r"^ab*c$": "a", r"^abc|d$": "", r"^a(b|c)|d$": "",
             r"^a\d+$": "a", r"^[ab]c$": "", r"^x{2}y$": "", r"^a\.b+$": "a.", r"^a(?:b(?:c(?:d(?:e|f))))$": ""}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r["p"]: r["s"] for r in df.select("p", literal_start(df["p"]).alias("s")).collect()}
    for p, want in cases.items():
        # a shorter start is always right; these must be exactly so, or empty where it can't be told
        assert got[p] in (want, ""), p
    assert got[r"^\$\{dt-([1-9][0-9]*|0)\}$"] == "${dt-" and got[r"^abc|d$"] == ""


def test_first_declared_pattern_wins(spark):
    catalog = [(2, "any", r"^a.*$"), (1, "digits", r"^a[0-9]+$"), (1, "also digits", r"^a[0-9]+$"), (0, "none", None), (5, "either", r"^b|ccc$")]
    names = ["a1", "ax", "b", "ccc", "bccc", "", None, "a1", "a1\n"]
    out = match_by_catalog(spark.createDataFrame(list(enumerate(names)), "id long, placeholder string"),
                           spark.createDataFrame(catalog, "position int, variable string, pattern string"))
    got = {r["id"]: r["variable"] for r in out.collect()}
    assert got == {0: "also digits", 1: "any", 2: "either", 3: "either", 4: None, 5: None, 6: None, 7: "also digits", 8: None}


@pytest.mark.parametrize("width", [60, 3600, 86400 * 30])
def test_pairs_come_once_whatever_the_bins(spark, width):
    rng = random.Random(2)
    when = lambda: BASE + dt.timedelta(seconds=rng.randrange(0, 40000))
    runs = []
    for i in range(150):
        s = rng.choice([None, when(), when(), when()])
        e = rng.choice([None, s, s + dt.timedelta(seconds=rng.choice([0, 1, 59, 3600, 20000, -5]))]) if s else None
        runs.append((i, rng.choice(["a", None]), s, e))
    ranges = [(100 + i, rng.choice(["a", None]), s, s + dt.timedelta(seconds=rng.choice([-1, 0, 1, 600, 9000])))
              for i, s in enumerate(when() for _ in range(40))]
    out = running_between(spark.createDataFrame(runs, "id long, q string, started_at timestamp_ntz, ended_at timestamp_ntz"),
                          spark.createDataFrame(ranges, "range_id long, q string, from_at timestamp_ntz, to_at timestamp_ntz"),
                          by=["q"], width_s=width)
    last = max(t for _, _, f, t in ranges if f < t)
    want = sorted((i, r) for i, q, s, e in runs for r, rq, f, t in ranges
                  if s and f < t and q == rq and (e or last) >= s and s < t and (e or last) >= f)
    assert sorted((r["id"], r["range_id"]) for r in out.collect()) == want and want


def test_a_long_run_lies_in_few_nodes(spark):
    # 4.2e9 minutes: a row, or an array element, for each would not fit
    runs = spark.createDataFrame([(1, BASE, None), (2, dt.datetime(1902, 5, 6), BASE + dt.timedelta(minutes=90)), (3, BASE, BASE)],
                                 "id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    at = [dt.datetime(1850, 1, 1), dt.datetime(1931, 2, 3, 4, 5), BASE, BASE + dt.timedelta(hours=1), dt.datetime(5000, 1, 1), dt.datetime(9999, 12, 31)]
    ranges = spark.createDataFrame([(i, t, t + dt.timedelta(minutes=30)) for i, t in enumerate(at)], "range_id long, from_at timestamp_ntz, to_at timestamp_ntz")
    out = running_between(runs, ranges, as_of="9999-12-31 23:59:59.999999", width_s=60)
    assert sorted((r["id"], r["range_id"]) for r in out.collect()) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (2, 2), (2, 3), (3, 2)]


@pytest.mark.parametrize("width, block", [(1, 3), (60, 2), (3600, 1), (3600, 128)])
def test_pairs_come_once_whatever_the_nodes_and_blocks(spark, width, block):
    rng = random.Random(width + block)
    old = dt.datetime(1969, 12, 20)  # bins before and after 1970
    when = lambda: old + dt.timedelta(seconds=rng.randrange(0, 20 * 86400), microseconds=rng.choice([0, 0, 1, 999999]))
    runs = []
    for i in range(120):
        s = rng.choice([None, when(), when(), when(), old.replace(hour=12)])
        e = rng.choice([None, s, s + dt.timedelta(seconds=rng.choice([1, 59, 3600, 500000, 10**6, -5]), microseconds=rng.choice([0, -1, 1]))]) if s else None
        runs.append((i // 2, rng.choice([1, None]), {"n": i % 3}, s, e))
    runs += runs[:20]  # the same rows twice
    ranges = [(i, rng.choice([1, None]), s, s + dt.timedelta(seconds=rng.choice([-1, 0, 1, 600, 9000, 400000])))
              for i, s in enumerate([*(when() for _ in range(50)), *[r[3] for r in runs[:30] if r[3]], *[r[4] for r in runs[:30] if r[4]]])]
    # the key is an int on one side and a bigint on the other; a map can't be compared
    out = running_between(spark.createDataFrame(runs, "id long, q int, m map<string,int>, started_at timestamp_ntz, ended_at timestamp_ntz"),
                          spark.createDataFrame(ranges, "range_id long, q long, from_at timestamp_ntz, to_at timestamp_ntz"),
                          by=["q"], width_s=width, block_rows=block)
    assert out.dtypes == [("id", "bigint"), ("q", "int"), ("m", "map<string,int>"), ("started_at", "timestamp_ntz"), ("ended_at", "timestamp_ntz"),
                          ("range_id", "bigint"), ("from_at", "timestamp_ntz"), ("to_at", "timestamp_ntz")]
    last = max(t for _, _, f, t in ranges if f < t)
    want = sorted(str((i, q, m, s, e, r, f, t)) for i, q, m, s, e in runs for r, rq, f, t in ranges
                  if s and f < t and q == rq and (e or last) >= s and s < t and (e or last) >= f)
    assert sorted(str(tuple(r)) for r in out.collect()) == want and want


def test_nothing_to_pair(spark):
    runs = spark.createDataFrame([(1, BASE, None)], "id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    ranges = spark.createDataFrame([(1, BASE, BASE + dt.timedelta(1)), (2, BASE, BASE)], "range_id long, from_at timestamp_ntz, to_at timestamp_ntz")
    assert running_between(runs, ranges.where("range_id > 1")).count() == 0
    assert running_between(runs.where("id > 1"), ranges).count() == 0
    assert running_between(runs, ranges).count() == 1


def _rows_joined(plan):
    """Rows out of all sort-merge joins of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _rows_joined(plan.executedPlan())
    inner = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return (plan.metrics().apply("numOutputRows").value() if name == "SortMergeJoinExec" else 0) + sum(map(_rows_joined, inner))


def test_pairs_of_a_full_instant_come_from_blocks(spark):
    # 90,000 pairs in one bin: what is joined, and shuffled after it, is blocks
    runs = spark.createDataFrame([(i, BASE, BASE) for i in range(300)], "id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    ranges = spark.createDataFrame([(i, BASE, BASE + dt.timedelta(minutes=1)) for i in range(300)], "range_id long, from_at timestamp_ntz, to_at timestamp_ntz")
    out = running_between(runs, ranges)
    assert len({(r["id"], r["range_id"]) for r in out.collect()}) == 90000
    assert _rows_joined(out._jdf.queryExecution().executedPlan()) < 1500


def test_no_side_goes_through_the_driver(spark):
    # small before it is cut into bins, large afterwards: an open run lies in 70,000 bins
    runs = spark.createDataFrame([(i, "a", BASE, None) for i in range(3)], "id long, q string, started_at timestamp_ntz, ended_at timestamp_ntz")
    ranges = spark.createDataFrame([(9, "a", BASE + dt.timedelta(days=n), BASE + dt.timedelta(days=n, hours=1)) for n in (1, 2900)],
                                   "range_id long, q string, from_at timestamp_ntz, to_at timestamp_ntz")
    out = running_between(runs, ranges, by=["q"])
    assert out.count() == 6
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()  # with what was changed while it ran
    assert "SortMergeJoin" in plan and not re.search("Broadcast|NestedLoop|Cartesian", plan), plan


def test_concurrency_line(spark):
    at = lambda m, s=0: BASE + dt.timedelta(minutes=m, seconds=s)
    runs = [("a", at(0, 30), at(2)), ("a", at(1), at(1, 59)), ("a", at(2), None), ("b", at(5), at(5)), ("a", at(9), at(8)), ("a", None, at(3))]
    df = spark.createDataFrame(runs, "q string, started_at timestamp_ntz, ended_at timestamp_ntz")
    got = sorted((r["q"], r["minute"], r["running"]) for r in concurrency_by_minute(df, "q").collect())
    # minute 2: one run touches it to its end, one has ended in minute 1, one starts
    assert got == [("a", at(0), 1), ("a", at(1), 2), ("a", at(3), 1), ("b", at(5), 1), ("b", at(6), 0)]
