"""Audit by path against a plain walk; stored summaries against exact values."""

import datetime as dt
import json
import math
import random

from pyspark.sql import functions as F

from batchwright.operators.audit import audit_paths
from batchwright.operators.rollups import (between_days, days_apart, merged_distinct, merged_percentiles, set_rollup,
                                           value_rollup)


def step(k):
    return f".{k}" if k.isascii() and k.replace("_", "a").isalnum() else '."' + k.replace("\\", "\\\\").replace('"', '\\"') + '"'


def walk(v, path="$"):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from walk(x, path + step(k))
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]")
    else:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        yield path, (kind, v)


def value(rng, depth):
    if depth and rng.random() < 0.5:
        if rng.random() < 0.5:
            return {rng.choice(["a", "b", "x.y", 'q"q', "back\\slash", "", "é"]): value(rng, depth - 1) for _ in range(rng.randrange(0, 4))}
        return [value(rng, depth - 1) for _ in range(rng.randrange(0, 4))]
    return rng.choice([1, 2, 2.5, -3, "1", "text", "", True, False, None, 10 ** 12])


def test_paths_equal_a_plain_walk(spark):
    rng = random.Random(3)
    pairs = [(value(rng, 4), value(rng, 4)) for _ in range(120)] + [(v, v) for v in (value(rng, 5) for _ in range(20))]
    texts = [(i % 100, None if i % 17 == 0 else json.dumps(a), None if i % 19 == 1 else json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    want = []
    for i, a, b in texts:
        old = dict(walk(json.loads(a))) if a is not None else {}
        new = dict(walk(json.loads(b))) if b is not None else {}
        for p in old.keys() | new.keys():
            x, y = old.get(p), new.get(p)
            if x != y:
                want.append((i, p, "added" if x is None else "removed" if y is None else "changed",
                             x and x[0], y and y[0]))
    df = spark.createDataFrame(texts, "id long, before_json string, after_json string")
    got = [(r["id"], r["path"], r["change"], r["old_type"], r["new_type"]) for r in audit_paths(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 200


def test_order_and_number_forms_are_no_change(spark):
    same = [('{"x":1,"y":{"a":[1,2],"b":null}}', '{"y":{"b":null,"a":[1.0,2e0]},"x":1.00}'), ("[]", " [ ] "), ('{"a":[{}]}', '{"a":[{}]}'),
            ("0.5", "5e-1"), ("12345678.5", "1.23456785e7"), (None, None), ("[null]", "[null]"), ("[[]]", "[[]]")]
    differ = [('{"x":1}', '{"x":"1"}'), ("[1,2]", "[2,1]"), ("[]", "{}"), ("[null]", "[]"), ("100000000000000001", "100000000000000002"), ("[]", "[[]]")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(same + differ)], "id long, before_json string, after_json string")
    got = {}
    for r in audit_paths(df).collect():
        got.setdefault(r["id"], []).append((r["path"], r["change"], r["before"], r["after"]))
    assert sorted(got) == list(range(len(same), len(same) + len(differ)))
    at = len(same)
    assert got[at] == [("$.x", "changed", "1", "1")] and len(got[at + 1]) == 2 and got[at + 2] == [("$", "changed", "[]", "{}")]


def test_malformed_texts_and_odd_keys(spark):
    df = spark.createDataFrame([(None, "{", "{}"), (1, '{"a":1,"a":2}', None), (1, None, '{"a":1}'), (1, '{"a":1}', None)],
                               "id long, before_json string, after_json string")
    got = sorted(((r["id"], r["path"], r["change"]) for r in audit_paths(df).collect()), key=str)
    assert got == sorted([(None, None, "malformed"), (1, None, "malformed"), (1, "$.a", "added"), (1, "$.a", "removed")], key=str)
    assert audit_paths(df.limit(0)).count() == 0


def test_percentiles_of_merged_days_are_within_the_error(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), dt.date(2024, 1, rng.randrange(1, 31)), rng.choice([None, 0, -5, 1])
             if rng.random() < 0.02 else int(math.exp(rng.uniform(0, 12)))) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, d date, x long")
    stored = value_rollup(df, ["g"], "d", "x")
    assert stored.count() <= 3 * 30
    for first, last in (("2024-01-01", "2024-01-31"), ("2024-01-05", "2024-01-05"), ("2024-01-10", "2024-01-20")):
        out = merged_percentiles(between_days(stored, first, last), ["g"], [0.5, 0.95, 0.99], ["p50", "p95", "p99"])
        for r in out.collect():
            own = sorted(x for g, d, x in rows if g == r["g"] and x is not None and first <= str(d) <= last)
            assert r["n"] == len(own)
            for p, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
                exact = own[math.ceil(p * len(own)) - 1]
                assert abs(r[c] - exact) <= 0.01 * exact + 0.001 if exact >= 1 else r[c] == 0
    assert between_days(stored, "2025-01-01", "2025-01-31").count() == 0


def test_set_sketches_against_exact_counts(spark):
    ids = spark.range(60000).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").cast("string").alias("i"))
    df = ids.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("d"), F.lit("g").alias("g"), "i") \
        .unionByName(ids.where("k = 0").select(F.lit("2024-01-02").cast("date").alias("d"), F.lit("g").alias("g"), "i"))
    small = set_rollup(df, ["g"], "d", "i", lg=10)
    got = merged_distinct(small, ["g"], lg=10).first()["n_distinct"]
    assert abs(got - 60000) < 5 * 60000 / 2 ** 5
    first = [r for r in days_apart(small, ["g"]).collect() if str(r["day"]) == "2024-01-01"][0]
    assert abs(first["n_both"] - 20000) < 5 * 40000 / 2 ** 5 and abs(first["n_either"] - 40000) < 5 * 40000 / 2 ** 5
    few = spark.createDataFrame([(None, None, "x"), ("g", dt.date(2024, 1, 1), None), ("g", dt.date(2024, 1, 1), "x"), ("g", dt.date(2024, 1, 1), "x"),
                                 (None, dt.date(2024, 1, 1), "y"), (None, dt.date(2024, 1, 2), "y")], "g string, d date, i string")
    stored = set_rollup(few, ["g"], "d", "i")
    assert sorted(map(tuple, merged_distinct(stored, ["g"]).collect()), key=str) == [("g", 1), (None, 1)]
    assert [tuple(r)[1:] for r in days_apart(stored, ["g"]).collect()] == [(None, 1, 1, 1)]
