import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchwright.llm import lexical as L
from batchwright.llm.common import table
from batchwright.llm.decontaminate import words_of
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def brute(docs, items, k=50):
    """Every document's full score for every item, sorted."""
    words = [(i, Counter(words_of((t or "").encode()))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, size = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(w for _, c in words for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words_of((t or "").encode()))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in words:
            m = 100 - 50 + (50 * sum(c.values()) * n) // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m))
                    for w in terms if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if lone else d, -s) for r, (s, lone, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_types(spark):
    df = L.op13_lexical_search(spark, SMALL)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


@pytest.mark.parametrize("k, block_docs, block_words", [(1, 3, 4_000_000), (5, 64, 300), (50, 2048, 4_000_000)])
def test_equals_full_scores_for_any_blocks(spark, k, block_docs, block_words):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert rows_of(L.search(docs.repartition(3), items, k, block_docs=block_docs, block_words=block_words)) == want


WORDS = st.sampled_from("a b c d e f g h".split())
TEXTS = st.lists(st.lists(WORDS, min_size=1, max_size=12), min_size=1, max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS.map(lambda x: x[:4]), st.integers(1, 4), st.integers(1, 8))
def test_pair_bounds_lose_no_document(docs, asked, k, block):
    """Without Spark: blocks of profiles, index rows and search, against full scores."""
    items = L.Items([(i, sorted({w.encode() for w in ws})) for i, ws in enumerate(asked)])
    counts = [Counter(ws) for ws in docs]
    n, size = len(docs), sum(map(len, docs))
    df = np.array([sum(w.decode() in c for c in counts) for w in items.number], np.int64)
    items.pair_up(df)
    w = L.weights(n, df)
    best = [L.Best(k) for _ in asked]
    for lo in range(0, n, block):
        own = counts[lo:lo + block]
        impact = {t: [(p, int(w[t]) * ((1000000000 * c[x.decode()]) // (1000 * c[x.decode()] + 20 * (50 + 50 * sum(c.values()) * n // size))))
                      for p, c in enumerate(own) if x.decode() in c] for x, t in items.number.items()}
        here = [t for t in impact if impact[t]]
        pairs = [(p, sorted(set(dict(impact[a])) & set(dict(impact[b])))) for p, (a, b) in enumerate(items.pairs)]
        pairs = [(p, c) for p, c in pairs if c]
        row = {"docs": list(range(lo, lo + len(own))), "terms": L.raw(here, "<i4"),
               "ends": L.raw(np.cumsum([len(impact[t]) for t in here]), "<i4"),
               "places": L.raw([p for t in here for p, _ in impact[t]], "<i4"),
               "impacts": L.raw([x for t in here for _, x in impact[t]], "<i8"),
               "tops": L.raw([max(x for _, x in impact[t]) for t in here], "<i8"),
               "pairs": L.raw([p for p, _ in pairs], "<i4"), "pair_ends": L.raw(np.cumsum([len(c) for _, c in pairs]), "<i4"),
               "pair_places": L.raw([x for _, c in pairs for x in c], "<i4"),
               "joint": L.raw([max(dict(impact[items.pairs[p][0]])[x] + dict(impact[items.pairs[p][1]])[x] for x in c)
                               for p, c in pairs], "<i8")}
        b = L.Block(row, len(items.number), len(items.pairs))
        for unit, top in zip(items.units, best):
            L.answer(b, unit, top)
    got = [(i, r, int(d), int(s)) for i, t in enumerate(best) for r, (d, s) in enumerate(zip(t.ids, t.score), 1)]
    assert sorted(got, key=repr) == brute([(i, " ".join(ws)) for i, ws in enumerate(docs)],
                                          [(i, " ".join(ws)) for i, ws in enumerate(asked)], k)


def test_pairs_skip_what_single_maxima_cannot(spark):
    """Two terms that never meet: the pair's bound is the larger one, and the
    block is passed over although the single maxima sum up above the threshold."""
    items = L.Items([(0, [b"a", b"b"])])
    items.pair_up(np.array([5, 4]))
    row = {"docs": [1, 2], "terms": L.raw([0, 1], "<i4"), "ends": L.raw([1, 2], "<i4"), "places": L.raw([0, 1], "<i4"),
           "impacts": L.raw([60, 70], "<i8"), "tops": L.raw([60, 70], "<i8"), "pairs": b"", "pair_ends": b"", "pair_places": b"",
           "joint": b""}
    best = L.Best(1)
    best.merge(np.array([100]), np.array([9]), np.array([False]))
    assert L.answer(L.Block(row, 2, 1), items.units[0], best) == 0
    row |= {"pairs": L.raw([0], "<i4"), "pair_ends": L.raw([1], "<i4"), "pair_places": L.raw([0], "<i4"), "joint": L.raw([130], "<i8")}
    assert L.answer(L.Block(row, 2, 1), items.units[0], best) == 0 and best.score.tolist() == [100]


def test_index_keeps_intersections_and_joint_maxima(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a"), (3, "b a a a"), (4, "b")], "doc_id bigint, text string").coalesce(1)
    items = L.Items([(0, [b"a", b"b"])])
    found = L.profiles(docs, L.Shared(spark, items))
    n, size, df = L.statistics(found, 2)
    assert (n, size, df.tolist()) == (4, 9, [3, 3])
    items.pair_up(df)
    [r] = L.index(found, n, size, L.weights(n, df), items.pairs).collect()
    b = L.Block(r.asDict(), 2, 1)
    assert b.pair_places.tolist() == [0, 2] and b.joint[0] <= b.top.sum() and b.joint[0] >= b.top.max()


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "words one", 0), (None, "two id", 0), (1, "nothing", 0), (2, None, 0), (3, "...", 0), (1, "nothing", 0)],
                                  "item_id bigint, text string, score int")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = brute(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(L.search(odd_docs, items)) == want and want
    assert rows_of(L.search(no_docs, items)) == [] and rows_of(L.search(odd_docs, items.where("false"))) == []
    named = L.search(odd_docs, items.selectExpr("cast(item_id as string) item_id", "text"))
    assert {r["item_id"] for r in named.collect()} == {"1", None}
