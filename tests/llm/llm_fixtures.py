"""Fixtures that the operators' tests import."""

import pytest

LONG = "one two three four five six seven eight nine ten " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and
    extra columns under the names that operators add."""
    rows = [
        (1, "plain words stand here and nothing else does", "en", "a"),
        (1, "plain words stand here and nothing else does", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, LONG, "en", "a"),
        (None, "a text that has no id at all", "en", "a"),
        (5, "ÉTÉ İstanbul 中文字符 ́ 😀 ß", "de", "b"),
        (6, "... --- !!!", "de", "b"),
        (None, None, None, None),
    ]
    schema = "doc_id bigint, text string, lang string, source string"
    extra = ("score", "spans", "ids", "hits", "items", "hi", "lo", "label", "rep", "n_words", "start", "decoded")
    df = spark.createDataFrame(rows, schema)
    for name in extra:
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
