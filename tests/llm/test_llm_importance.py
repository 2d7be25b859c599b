import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from batchwright.llm import importance as I
from batchwright.llm.common import table
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"
WORDS = [b"a", b"ab", b"b", b"\xc3\xa9t\xc3\xa9", b"x" * 64, b"y" * 65, b"z" * 1000, "中文".encode()]
SCANS = [I.Scanner(WORDS[:n]) for n in (0, 2, 5, 8)]


def plain(words):
    pairs = [x + b" " + y for x, y in zip(words, words[1:])]
    return [zlib.crc32(f) % I.BUCKETS for f in words + pairs]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=30))
def test_composed_buckets_equal_hashed_bytes(words):
    """With every part of the words in the dictionary, or none."""
    for scan in SCANS:
        assert scan.features(words).tolist() == plain(words)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    like = [r["text"] for r in table(spark, SMALL, "benchmark").collect()]
    df = I.op12_importance(spark, SMALL)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        (c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    got = rows_of(df)
    assert got == sorted(I.brute_force(docs, like), key=repr)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_the_dictionary_changes_nothing(spark):
    docs, like = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    want = rows_of(I.resample(docs, like))
    assert rows_of(I.resample(docs.repartition(5), like, words=50, sample=20)) == want
    assert rows_of(I.resample(docs, like, words=0)) == want


def test_equal_scores_go_by_id(spark):
    """One text under one id many times, and null ids: ranks stay 1, 2, 3..."""
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(7, text)] * 30 + [(None, text)] * 10 + [(i, text) for i in range(20)] + [(99, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    like = spark.createDataFrame([("one two three",)], "text string")
    assert rows_of(I.resample(docs, like)) == sorted(I.brute_force(rows, ["one two three"]), key=repr)


def test_odd_rows(spark, odd_docs, no_docs):
    like = table(spark, SMALL, "benchmark")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    goal = [r["text"] for r in like.collect()]
    assert rows_of(I.resample(odd_docs, like.withColumn("score", like["text"]))) == sorted(I.brute_force(rows, goal), key=repr)
    assert I.resample(no_docs, like).count() == 0
    none = spark.createDataFrame([(None,)], "text string")
    for target in (none, none.where("false")):
        assert rows_of(I.resample(odd_docs, target)) == sorted(I.brute_force(rows, []), key=repr)


def test_gains_by_hand():
    own, like = np.zeros(4, np.int64), np.zeros(4, np.int64)
    own[1], like[2] = 6, 2
    # (t + 1) * (6 + 4) / ((s + 1) * (2 + 4))
    assert I.gains_of(own, like).tolist() == [510, -1436, 1609, 510]
