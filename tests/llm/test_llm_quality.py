import math

import numpy as np
from pyspark.sql import functions as F

from batchwright.llm import quality as Q
from llm_fixtures import no_docs, odd_docs  # noqa: F401

MEDIUM = "/root/testdata/sf0.01"


def test_sparse_product_equals_the_score_used(spark):
    rng = np.random.default_rng(2)
    m = Q.Model(rng.normal(size=Q.DIM), 0.3)
    texts = ["", None, "a", "a a a b", "UPPER!! CASE!! words | and | bars 12 12", "ein kurzer Text. ein kurzer Text."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in Q.score(df, m).collect():
        at, value = Q.sparse(texts[r["doc_id"]] or "")
        assert math.isclose(r["score"], Q.logistic(m.bias + float(m.weights[at] @ value)), rel_tol=1e-9)


def test_ftrl_separates_and_l1_leaves_zeros():
    rows = [(np.array([0, 5 + i % 20]), np.array([1.0, 0.1]), 1) for i in range(200)]
    rows += [(np.array([1, 5 + i % 20]), np.array([1.0, 0.1]), 0) for i in range(200)]
    m = Q.ftrl([rows[i // 2 + 200 * (i % 2)] for i in range(400)], dim=64, l1=0.5)
    assert m.weights[0] > 0.5 > -0.5 > m.weights[1] and not m.weights[30:].any()


def test_ftrl_equals_a_loop_over_coordinates():
    """The update written out for one coordinate at a time, in plain numbers."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4), int(rng.random() < 0.5)) for _ in range(60)]
    alpha, beta, l1, l2, dim = 0.5, 1.0, 0.02, 0.1, 12
    z, n = [0.0] * (dim + 1), [0.0] * (dim + 1)

    def weight(i):
        if i == dim:
            return -z[i] * alpha / (beta + math.sqrt(n[i]))
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for at, value, label in rows:
            x = {**dict(zip(at.tolist(), value.tolist())), dim: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    m = Q.ftrl(rows, dim=dim, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(m.weights, [weight(i) for i in range(dim)], atol=1e-12) and math.isclose(m.bias, weight(dim), rel_tol=1e-9)


def test_held_out_accuracy(spark):
    rows = Q.op8_quality(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    got = rows.join(labels, "doc_id").where("held_out").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right")).first()
    assert got["n"] > 60 and got["right"] > 0.93
    assert rows.where("predicted <> cast(score >= 0.7 as int) or score < 0 or score > 1").count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id bigint, quality int")
    m = Q.fit(odd_docs, labels)
    rows = Q.score(odd_docs, m).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert Q.score(no_docs, m).count() == 0
    none = Q.fit(odd_docs, labels.where("false"))
    assert {r["score"] for r in Q.score(odd_docs, none).collect()} == {0.5}


def test_memo_may_start_anew(monkeypatch):
    text = " ".join(f"word{i}" for i in range(50))
    want = Q.sparse(text)
    monkeypatch.setattr(Q, "MEMO", 4)
    Q.kept("other", dict)
    got = Q.sparse(text)
    assert (want[0] == got[0]).all() and np.allclose(want[1], got[1])
