"""Causes of waiting against a walk along the blockers."""

import datetime as dt
import random

from batchwright.operators.waiting import waiting_causes

DAY = dt.date(2024, 1, 1)


def walk(ok, deps):
    """{node: (cause, node of the cause, depth)}; ok: {(task, day): succeeded}."""
    block = {}
    for (t, d), good in ok.items():
        ups = sorted((u, d - dt.timedelta(days=o)) for x, u, o in deps if x == t)
        bad = [u for u in ups if not ok.get(u, False)]
        if not good and bad:
            block[t, d] = bad[0]
    out = {}
    for v in block:
        path, at = [v], block[v]
        while at in block and at not in path:
            path.append(at)
            at = block[at]
        if at in path:
            out[v] = ("cycle", min(path[path.index(at):]), None)
        else:
            out[v] = ("failed" if at in ok else "missing", at, len(path))
    return out


def check(spark, ok, deps):
    inst = spark.createDataFrame([(t, d, g) for (t, d), g in ok.items()], "task_id long, biz_date date, ok boolean")
    need = spark.createDataFrame(deps, "task_id long, upstream_id long, offset int")
    rows = waiting_causes(inst, need).collect()
    got = {(r["task_id"], r["biz_date"]): (r["cause"], (r["cause_task"], r["cause_date"]), r["depth"]) for r in rows}
    assert len(rows) == len(got) and got == walk(ok, deps)
    return got


def test_chains_cycles_and_missing_instances(spark):
    n = 37
    ok = {(t, DAY): False for t in range(n)}                                  # a chain of 37, rooted in a failure
    ok |= {(t, DAY): False for t in range(100, 107)} | {(t, DAY): False for t in range(200, 203)}
    ok |= {(300, DAY): True, (301, DAY): False, (302, DAY): False}
    deps = [(t, t - 1, 0) for t in range(1, n)] + [(t, 100 + (t - 99) % 7, 0) for t in range(100, 107)]  # a cycle of seven
    deps += [(200, 201, 0), (201, 202, 0), (202, 103, 0)]                     # a tail into it
    deps += [(301, 300, 0), (302, 999, 1)]                                    # a success above; no such instance
    got = check(spark, ok, deps)
    assert got[36, DAY] == ("failed", (0, DAY), 36) and got[200, DAY] == ("cycle", (100, DAY), None)
    assert (301, DAY) not in got and got[302, DAY] == ("missing", (999, DAY - dt.timedelta(days=1)), 1)


def test_a_long_tail_in_rising_order_names_the_cycle(spark):
    """The smallest instance on the way is always the first; the cycle's is found all the same."""
    ok = {(t, DAY): False for t in range(40)}
    got = check(spark, ok, [(t, t + 1, 0) for t in range(39)] + [(39, 38, 0)])
    assert set(got.values()) == {("cycle", (38, DAY), None)}


def test_random_graphs(spark):
    rng = random.Random(3)
    ok = {(t, DAY + dt.timedelta(days=d)): rng.random() < 0.15 for t in range(12) for d in range(8) if rng.random() < 0.9}
    check(spark, ok, [(rng.randrange(12), rng.randrange(12), rng.randrange(3)) for _ in range(20)])


def test_nothing_waits(spark):
    assert check(spark, {(1, DAY): True}, [(1, 2, 0)]) == {}
    inst = spark.createDataFrame([(None, DAY, False), (1, None, False)], "task_id long, biz_date date, ok boolean")
    assert waiting_causes(inst, spark.createDataFrame([(1, 1, 0)], "task_id long, upstream_id long, offset int")).count() == 0
