import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchwright.llm import langid as L
from llm_fixtures import no_docs, odd_docs  # noqa: F401

MEDIUM = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text("ab é.", max_size=40))
def test_trigrams_equal_counting_by_hand(text):
    low = text.lower()
    codes = [ord(c) if c.isalpha() else 0 for c in low]
    line = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
    if any(codes):
        line = [0] * (line[0] != 0) + line + [0] * (line[-1] != 0)
        want = {}
        for a, b, c in zip(line, line[1:], line[2:]):
            want[a << 42 | b << 21 | c] = want.get(a << 42 | b << 21 | c, 0) + 1
    else:
        want = {}
    grams, counts = L.trigrams(text)
    assert dict(zip(grams.tolist(), counts.tolist())) == want


def test_profile_is_the_sum_of_bound_letters():
    text, dim = "ab ca", 64
    v = lambda c: L.letter(ord(c) if c != " " else 0, dim).astype(int)
    line = " ab ca "
    want = sum(np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in zip(line, line[1:], line[2:]))
    assert (L.profiles([L.trigrams(text)], dim)[0] == want).all()


def test_profiles_in_parts(monkeypatch):
    found = [L.trigrams("some words of a text"), L.trigrams(""), L.trigrams("autres mots d'un texte")]
    whole = L.profiles(found, 128)
    monkeypatch.setattr(L, "GRAMS", 5)
    assert (L.profiles(found, 128) == whole).all() and not whole[1].any()


def test_held_out_accuracy(spark):
    rows = L.op5_language_id(spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    got = rows.join(docs, "doc_id").where("held_out").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert rows.count() == docs.count() and got["n"] > 200 and got["right"] > 0.97


def test_odd_rows(spark, odd_docs, no_docs):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the words and the text", "en"), ("der und die das nicht", "de"), (None, "en"), ("", "xx")] * 5)],
        "doc_id bigint, text string, lang string")
    rows = L.predict(odd_docs, L.fit(train)).collect()
    assert len(rows) == 9
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (2, 3, 6)} == {("und", 0.0)}
    assert all(r["lang_pred"] in ("en", "de", "xx") and 0 <= r["score"] <= 1 for r in rows if r["doc_id"] in (1, 4, 5))
    assert L.predict(no_docs, L.fit(train)).count() == 0
    nothing = L.fit(train.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in L.predict(odd_docs, nothing).collect()} == {("und", 0.0)}


def test_learns_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    a, b = L.fit(docs, bound=30), L.fit(docs.repartition(7), bound=30)
    assert a[0] == b[0] and (a[1] == b[1]).all()
