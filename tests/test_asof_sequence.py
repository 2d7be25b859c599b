"""As-of join and the ordered helpers against brute-force loops, on random data
with a hot key, NULL keys and NULL times, and for any bound on rows per slot."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchwright.operators.asof import as_of_join
from batchwright.operators.sequence import MAX_ROWS, forward_fill, previous_value, running_peak, slotted

BASE = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
BOUNDS = (MAX_ROWS, 1, 3)

times = st.one_of(st.none(), st.integers(min_value=0, max_value=96).map(lambda h: BASE + dt.timedelta(hours=h)))
keys = st.sampled_from(["hot", "hot", "hot", "a", None, None])


def at(t):
    """NULL times come first."""
    return (t is not None, t)


@SETTINGS
@given(right=st.lists(st.tuples(keys, times, st.integers(0, 5)), max_size=30),
       left=st.lists(st.tuples(keys, times), min_size=1, max_size=20))
def test_as_of_matches_brute_force(spark, right, left):
    r_rows = [(k, t, f"v{i}", i * 10 + s) for i, (k, t, s) in enumerate(right)]
    l_rows = [(i, k, t) for i, (k, t) in enumerate(left)]
    rdf = spark.createDataFrame(r_rows, "k string, eff timestamp_ntz, value string, seq long")
    ldf = spark.createDataFrame(l_rows, "id long, k string, at timestamp_ntz")
    want = {}
    for i, k, t in l_rows:
        found = [x for x in r_rows if t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        best = max((c[1] for c in found), default=None)
        want[i] = min((c for c in found if c[1] == best), key=lambda c: c[3])[2] if found else None
    for m in BOUNDS:
        got = as_of_join(ldf, rdf, ["k"], "at", "eff", ["value"], tie="seq", max_rows=m).collect()
        assert len(got) == len(l_rows) and {r["id"]: r["value"] for r in got} == want


@SETTINGS
@given(rows=st.lists(st.tuples(keys, times, st.sampled_from(["a", "b", None])), min_size=1, max_size=40))
def test_previous_and_forward_fill(spark, rows):
    data = [(k, t, i, v) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, tie long, v string")
    want_prev, want_fill = {}, {}
    for k in {d[0] for d in data}:
        last = before = None
        for d in sorted([d for d in data if d[0] == k], key=lambda d: (at(d[1]), d[2])):
            want_prev[d[2]], before = before, d[3]
            last = d[3] if d[3] is not None else last
            want_fill[d[2]] = last
    for m in BOUNDS:
        prev = {r["tie"]: r["prev"] for r in previous_value(df, ["k"], "ts", "tie", "v", max_rows=m).collect()}
        fill = {r["tie"]: r["filled"] for r in forward_fill(df, ["k"], "ts", "tie", "v", max_rows=m).collect()}
        assert prev == want_prev and fill == want_fill


@SETTINGS
@given(runs=st.lists(st.tuples(keys, times.filter(lambda t: t is not None), st.integers(0, 30)), min_size=1, max_size=30))
def test_running_peak(spark, runs):
    deltas = []
    for i, (k, t, hours) in enumerate(runs):
        deltas.append((k, t, 1, i))
        deltas.append((k, t + dt.timedelta(hours=hours), -1, i))
    df = spark.createDataFrame(deltas, "k string, t timestamp_ntz, d int, id long")
    want = {}
    for k in {d[0] for d in deltas}:
        run = best = 0
        for d in sorted([d for d in deltas if d[0] == k], key=lambda d: (d[1], d[2], d[3])):
            run += d[2]
            best = max(best, run)
        want[k] = best
    for m in BOUNDS:
        got = running_peak(df, ["k"], "t", "d", "id", max_rows=m).collect()
        assert {r["k"]: r["peak_running"] for r in got} == want


def test_as_of_null_times_never_match(spark):
    t = BASE + dt.timedelta(days=3)
    rdf = spark.createDataFrame(
        [("k", None, "vnull", 0), ("k", BASE, "v0", 1), ("k", BASE + dt.timedelta(days=1), "v1", 2),
         ("k", BASE + dt.timedelta(days=1), "v1b", 1)],
        "k string, eff timestamp_ntz, value string, seq long")
    ldf = spark.createDataFrame([(1, "k", None), (2, "k", t), (3, "k", BASE - dt.timedelta(hours=1)),
                                 (4, "other", t)], "id long, k string, at timestamp_ntz")
    got = {r["id"]: (r["value"], r["matched_eff"])
           for r in as_of_join(ldf, rdf, ["k"], "at", "eff", ["value"], tie="seq").collect()}
    # id 2: two rows share the latest time; the smaller seq (stored first) wins
    assert got == {1: (None, None), 2: ("v1b", BASE + dt.timedelta(days=1)), 3: (None, None),
                   4: (None, None)}


CROWDS = {
    "one instant, numeric tie": [(BASE, i) for i in range(3000)],
    "no times at all": [(None, i) for i in range(3000)],
    "two instants, ties of 64 bits": [(BASE + dt.timedelta(days=i % 2), (-1) ** i * (2 ** 63 - 1 - i)) for i in range(3000)],
    "an outlier far from the rest": [(dt.datetime(1, 1, 1), -1)] + [(BASE + dt.timedelta(minutes=i), i) for i in range(2000)],
}


@pytest.mark.parametrize("name", CROWDS)
@pytest.mark.parametrize("struct", [False, True])
def test_large_keys_are_cut_wherever_their_rows_lie(spark, name, struct):
    rows = [("hot", t, i) for t, i in CROWDS[name]] + [("cold", BASE, 5), ("cold", None, 6), (None, BASE, 7)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long")
    if struct:  # a tie of two fields, as in the history of publishes
        df = df.withColumn("id", F.struct(F.lit(0).alias("rank"), F.col("id")))
    [b], cut = slotted([df], ["k"], ["t", "id"], max_rows=100)
    got = sorted(((at(r["t"]), tuple(r["id"]) if struct else r["id"], r["_b"]) for r in b.where("k = 'hot'").collect()))
    slots = [x[2] for x in got]
    assert cut and len(got) == len(CROWDS[name]) and slots == sorted(slots)
    assert max(slots.count(x) for x in set(slots)) <= 100
    assert b.where("_b is null").count() == 3
    assert not slotted([df], ["k"], ["t", "id"], max_rows=10_000)[1]
    prev = {(r["k"], r["t"], str(r["id"])): r["prev"] for r in previous_value(df, ["k"], "t", "id", "t", max_rows=100).collect()}
    assert prev == {(r["k"], r["t"], str(r["id"])): r["prev"] for r in previous_value(df, ["k"], "t", "id", "t").collect()}


def test_frames_share_their_slots(spark):
    a = spark.createDataFrame([("k", i, f"a{i}") for i in range(50)], "k string, o long, x string")
    b = spark.createDataFrame([("k", i, 2.0 * i) for i in range(25, 90)], "k string, o long, y double")
    (a, b), cut = slotted([a, b], ["k"], ["o"], max_rows=10)
    assert a.columns == ["k", "o", "x", "_b"] and b.columns == ["k", "o", "y", "_b"]
    both = sorted([(r["o"], r["_b"]) for r in a.collect()] + [(r["o"], r["_b"]) for r in b.collect()])
    assert cut and [s for _, s in both] == sorted(s for _, s in both) and len(both) == 115


STATES = ["pending", "submitting", "running", "succeeded", "failed", "killed", "unheard of", None]


@pytest.mark.parametrize("max_rows, fan", [(MAX_ROWS, 256), (MAX_ROWS, 2), (20, 3)])
def test_replay_leaves_the_state_where_a_move_is_rejected(spark, max_rows, fan):
    from batchwright.operators.lifecycle import LEGAL_EDGES
    from batchwright.operators.replay import replay, true_states
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, BASE + dt.timedelta(hours=rng.randrange(60))]),
             rng.choice(STATES[:4] * 3 + STATES)) for _ in range(150)]
    data = [(k, t, i, s) for i, (k, t, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "instance_id string, ts timestamp_ntz, event_id long, state string")
    want, final = {}, {}
    for k in {d[0] for d in data}:
        now = "start"
        for d in sorted([d for d in data if d[0] == k], key=lambda d: (at(d[1]), d[2])):
            legal = (now, d[3]) in LEGAL_EDGES
            want[d[2]] = (now, legal, d[3] if legal else now)
            now = want[d[2]][2]
        final[k] = now
    out = replay(df, LEGAL_EDGES, max_rows=max_rows, fan=fan)
    assert out.columns[:4] == df.columns
    got = out.collect()
    assert {r["event_id"]: (r["from_state"], r["legal"], r["true_state"]) for r in got} == want and len(got) == len(data)
    assert {r["instance_id"]: r["true_state"] for r in true_states(out).collect()} == final


def test_a_rejected_return_to_running_is_not_undone_by_the_next_event(spark):
    """succeeded -> running is refused, so running -> killed is refused too."""
    from batchwright.operators.lifecycle import LEGAL_EDGES
    from batchwright.operators.replay import replay
    states = ["pending", "submitting", "running", "succeeded", "running", "killed"]
    df = spark.createDataFrame([("i", BASE + dt.timedelta(hours=n), n, s) for n, s in enumerate(states)],
                               "instance_id string, ts timestamp_ntz, event_id long, state string")
    got = [(r["legal"], r["true_state"]) for r in replay(df, LEGAL_EDGES).orderBy("event_id").collect()]
    assert got == [(True, s) for s in states[:4]] + [(False, "succeeded")] * 2


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["hot", "hot", "a", "b"]),
                               st.one_of(st.none(), st.integers(0, 30))), min_size=1, max_size=60))
def test_exact_percentiles_match_nearest_rank(spark, rows):
    import math

    from pyspark.sql import functions as F

    from batchwright.operators.lifecycle import exact_percentiles
    df = spark.createDataFrame(rows, "g string, v long")
    ps = [0.01, 0.5, 0.95, 0.99, 1.0]
    names = ["p1", "p50", "p95", "p99", "p100"]
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", ps, names,
                                                counts={"n": F.lit(True)}).collect()}
    for g in {r[0] for r in rows}:
        vals = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g]["n"] == sum(1 for k, _ in rows if k == g)
        for p, nm in zip(ps, names):
            want = vals[max(math.ceil(p * len(vals)), 1) - 1] if vals else None
            assert got[g][nm] == want


@SETTINGS
@given(rows=st.lists(st.tuples(keys, times.filter(lambda t: t is not None),
                               st.sampled_from(["pending", "running", "failed", "succeeded"])),
                     min_size=1, max_size=50))
def test_trigger_dedupe_and_current_state_match_brute_force(spark, rows):
    from batchwright.operators.dedup import current_state, dedupe_triggers
    data = [(i, k, t, s) for i, (k, t, s) in enumerate(rows)]
    trig = spark.createDataFrame(
        [(i, k, "20240101", "schedule", None if k == "a" else BASE, t) for i, k, t, _ in data],
        "instance_id long, task_id string, biz_date string, trigger_source string, "
        "scheduled_at timestamp_ntz, created_at timestamp_ntz")
    got = {r["instance_id"]: r["first_instance_id"] for r in dedupe_triggers(trig).collect()}
    assert len(got) == len(data)
    ev = spark.createDataFrame([(i, k, t, s) for i, k, t, s in data],
                               "event_id long, instance_id string, ts timestamp_ntz, state string")
    cur = {r["instance_id"]: r["current_state"] for r in current_state(ev).collect()}
    for k in {d[1] for d in data}:
        group = [d for d in data if d[1] == k]
        first = min(group, key=lambda d: (d[2], d[0]))[0]
        assert all(got[d[0]] == first for d in group)
        assert cur[k] == max(group, key=lambda d: (d[2], d[0]))[3]


sides = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.integers(0, 2))), max_size=12)


@SETTINGS
@given(a=sides, b=sides)
def test_reconcile_and_compare_runs_match_lists(spark, a, b):
    from batchwright.operators.lifecycle import compare_runs, reconcile
    da, db = (spark.createDataFrame(x, "k long, v long") for x in (a, b))
    old, new = ({k: sorted((v for q, v in x if q == k), key=repr) for k, _ in x} for x in (a, b))
    rec = reconcile(da, db, ["k"]).collect()
    assert {r["k"]: (r["status"], r["n_a"], r["n_b"]) for r in rec} == {
        k: ("both" if k in old and k in new else "unsynced" if k in old else "orphan",
            len(old.get(k, ())), len(new.get(k, ()))) for k in {*old, *new}}
    cmp = compare_runs(da, db, ["k"], ["v"]).collect()
    assert len(rec) == len(cmp) == len({*old, *new})
    for r in cmp:
        x, y = old.get(r["k"]), new.get(r["k"])
        assert (r["n_old"], r["n_new"]) == (len(x or ()), len(y or ()))
        if y is None or x is None:
            assert (r["status"], r["changed_cols"]) == ("only_old" if y is None else "only_new", "")
        else:  # NULL equals NULL; a repeated key compares its values as a multiset
            changed = ["*"] * (len(x) != len(y)) + ["v"] * (x != y)
            assert (r["status"], r["changed_cols"]) == ("changed" if changed else "same", ",".join(changed))
