import math

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from batchwright.llm import topk as K

SMALL = "/root/testdata/sf0.001"


def brute(rows, query_ids, k):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted(query_ids):
        mine = [v for i, v in own if i == q]
        if not mine:
            continue
        q_vec = min(mine)
        found = sorted((-sum(a * b for a, b in zip(q_vec, v)), i) for i, v in own if i != q and len(v) == len(q_vec))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return out


def test_ties_repeats_nulls_and_lengths(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, 4) / 8]) for i in range(120)]
    rows += [(200, rows[5][1]), (200, rows[5][1]), (201, None), (202, [0.1, None, 0.2, 0.3]), (203, [float("nan")] * 4),
             (204, [float("inf"), 0.0, 0.0, 0.0]), (205, []), (206, [0.5, 0.5]), (210, [0.5, 0.25]), (None, [0.1] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as rank", "2 as score")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for block in (8192, 3):
        got = K.search(df.repartition(5), df.where("vec_id % 10 = 0"), 5, block_queries=block)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 5)
    assert K.search(df.where("false"), df.where("false")).count() == 0
    assert K.search(df, df.where("false")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** (8 + i % 30)), -float(i), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in K.search(df, df.where("vec_id % 10 = 0")).collect())
    limit, want = (1 << 63) - 1, []
    for q in (0, 10, 20, 30):  # scores beyond 64 bits stay at the limit, and tie there
        own = sorted((-min(s, limit), i) for _, _, i, s in brute(rows, {q}, 40))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(own[:5], 1)]
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40), st.integers(1, 6))
def test_tile_selection(values, k):
    ids = np.arange(len(values))
    best = K.Best(np.array([100]), np.array([[1.0]]), k)
    for lo in range(0, len(values), 7):
        best.add(ids[lo:lo + 7], np.array(values[lo:lo + 7], float)[:, None])
    want = sorted((-v, i) for i, v in enumerate(values))[:k]
    assert list(zip((-best.score[0][best.there[0]]).tolist(), best.found[0][best.there[0]].tolist())) == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = con.execute(K.ORACLES["op9_exact_topk"]).fetchall()
    assert sorted(tuple(r) for r in K.op9_exact_topk(spark, SMALL).collect()) == sorted(want) and want


def test_a_repeated_query_id_goes_by_its_valid_vectors(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, []), (1, [None, 1.0]), (1, [-inf, 0.0]), (1, [nan, nan]), (1, None)]
    valid = [(1, [1.0, 0.5]), (1, [2.0, 0.0])]
    rest = [(2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [])]

    def found(rows):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        return sorted(tuple(r) for r in K.search(df, df.where("vec_id = 1")).collect())

    want = found(valid + rest)
    assert [r[2] for r in want] == [2, 3]
    assert found(odd + valid + rest) == want
