import itertools
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchwright.llm import toxicity as X
from batchwright.llm.common import labelled_sample
from llm_fixtures import no_docs, odd_docs  # noqa: F401

MEDIUM = "/root/testdata/sf0.01"


def brute_marginals(f, evidence):
    """By summing over every labelling; evidence: a number, or None without a cue, per token."""
    n = len(evidence)
    mass, total = np.zeros(n), 0.0
    for y in itertools.product((0, 1), repeat=n):
        s = f.start[y[0]] + sum(f.moves[a][b] for a, b in zip(y, y[1:]))
        s += sum(f.bias + (e or 0.0) for e, v in zip(evidence, y) if v)
        p = math.exp(s)
        total += p
        mass += p * np.array(y)
    return mass / total


NUMBERS = st.floats(-2, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | NUMBERS, min_size=1, max_size=9), NUMBERS, st.lists(NUMBERS, min_size=6, max_size=6))
def test_marginals_equal_summing_over_labellings(evidence, bias, w):
    f = X.Field({}, bias, np.array(w[:2]), np.array(w[2:]).reshape(2, 2))
    at = [i for i, e in enumerate(evidence) if e is not None]
    got = X.Scorer(f).marginals(len(evidence), at, [evidence[i] for i in at])
    assert np.allclose(got, brute_marginals(f, evidence)[at], atol=1e-9)


def test_long_gaps_equal_one_step_at_a_time():
    f = X.Field({}, -3.0, np.array([0.1, -1.0]), np.array([[1.0, -1.0], [-0.5, 0.7]]))
    s = X.Scorer(f)
    for k in (X.POWERS, X.POWERS + 1, 5000):
        m = np.eye(2)
        for _ in range(k):
            m = m @ s.m
            m /= m.max()
        assert np.allclose(m, s.gap(k) / s.gap(k).max(), atol=1e-12)


def test_gradient_steps_raise_the_likelihood():
    rows = [([0, 1, 0], [[], [0], []])] * 20 + [([0, 0, 0], [[], [1], []])] * 20
    f = X.train(rows, ["bad", "fine"])
    assert f.cues["bad"] > 1 > -1 > f.cues["fine"]
    s = X.Scorer(f)
    assert s.marginals(3, [1], [f.cues["bad"]])[0] > 0.8 and s.marginals(3, [1], [f.cues["fine"]])[0] < 0.2


def test_held_out_accuracy_and_spans(spark):
    rows = X.op1_toxicity(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").where("held_out").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("right")).first()
    assert got["n"] > 50 and got["right"] > 0.93
    assert rows.where("predicted <> cast(score >= 0.5 as int) or score < 0 or score > 1").count() == 0


def test_spans_are_offsets_of_the_words():
    f = X.Field({"vile": 6.0}, -4.0, np.zeros(2), np.zeros((2, 2)), (0.0, 0.0, 0.0))
    text = "İ fine, VILE. 中文 vile"
    _, _, cues = X.Scorer(f).read(text)
    assert [text[s["start"]:s["end"]] for s in X.spans_of(text, cues, 0.5)] == ["VILE", "vile"]


def test_odd_rows(spark, odd_docs, no_docs):
    train = spark.createDataFrame(
        [(i, f"an ordinary text number {i} about things", 0) for i in range(60)]
        + [(100 + i, f"you vile creature number {i}", 1) for i in range(12)], "doc_id bigint, text string, toxic int")
    labels = train.select("doc_id", "toxic").unionByName(
        spark.createDataFrame([(None, 1), (7, None), (999, 1)], "doc_id bigint, toxic int"))
    m = X.fit(train, labels)
    assert "vile" in m.cues and m.score is not None
    rows = X.score(odd_docs, m).collect()
    assert len(rows) == 9 and all(0 <= r["score"] < 0.5 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    back = X.keep_clean(odd_docs, m)
    assert back.columns == odd_docs.columns and back.count() == 9
    assert X.score(no_docs, m).count() == 0 and X.keep_clean(no_docs, m).count() == 0
    kept = {r["doc_id"] for r in X.keep_clean(train, m).collect()}
    assert kept == set(range(60))
    none = X.fit(train, labels.where("toxic = 0"))
    assert {r["score"] for r in X.score(odd_docs, none).collect()} == {0.0}
    assert {r["score"] for r in X.score(odd_docs, X.fit(train, labels.where("false"))).collect()} == {0.0}


def test_sample_is_bounded_and_free_of_order(spark):
    """One id on many texts, labels that contradict each other, any order and partitions."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(7, f"copy {i}") for i in range(3000)] + [(7, "text 7")] * 50,
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(300)] + [(7, 1), (8, 1), (8, 0)], "doc_id bigint, toxic int")
    want = None
    for d, lab in ((docs, labels), (docs.repartition(7), labels.orderBy(F.desc("toxic"))), (docs.orderBy(F.desc("text")), labels.repartition(3))):
        got = sorted(map(tuple, labelled_sample(d, lab, "toxic", 100, 1).collect()))
        assert got == (want or got) and len(got) < 300
        want = got
    whole = {(i, y) for i, _, y in map(tuple, labelled_sample(docs, labels, "toxic", 10_000, 1).collect())}
    assert len(whole) == 300 and {(7, 1), (8, 1)} <= whole and {y for i, y in whole if i not in (7, 8)} == {0}


def test_windows_come_from_the_whole_text(spark):
    words = ["calm"] * 2000
    for i in range(0, 2000, 20):
        words[i] = "vile"
    sample = spark.createDataFrame([(1, " ".join(words))], "label int, text string")
    rows = X.windows(sample, ["vile"])
    assert len(rows) == X.PLACES + 1
    # a cue of the second half alone is seen too
    late = spark.createDataFrame([(1, " ".join(["vile"] * 500 + ["worse"] * 500))], "label int, text string")
    assert any(1 in own for _, cues in X.windows(late, ["vile", "worse"]) for own in cues)


def test_spans_cover_words_between_offending_cues():
    f = X.Field({"vile": 6.0, "mean": 6.0}, -1.0, np.zeros(2), np.array([[2.0, -2.0], [-2.0, 2.0]]), (0.0, 0.0, 0.0))
    s = X.Scorer(f)
    text = "you vile and mean one. " + "calm words here " * 10 + "vile"
    cues = s.read(text)[2]
    got = s.covered(text, cues, 0.5)
    n = len(X.words_of(text))
    at, evidence = s.active(X.words_of(text))
    exact = brute_marginals(f, [6.0 if w in (b"vile", b"mean") else None for w in X.words_of(text)[:6]])
    assert [text[x["start"]:x["end"]] for x in X.spans_of(text, got, 0.5)] == ["vile", "and", "mean", "vile"]
    assert abs(dict(got)[2] - s.marginals(n, sorted({*at, 2}), [0.0 if i == 2 else 6.0 for i in sorted({*at, 2})])[1]) < 1e-12
    assert exact[2] > 0.5
