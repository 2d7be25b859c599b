import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from batchwright.llm import jaccard as J
from batchwright.llm.components import components
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def brute(rows, words=5, num=4, den=5):
    """doc_id to (class_id, n_links) by comparing all pairs."""
    sets = [(i, frozenset(J.shingles(t or "", words).tolist())) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, root(i), links[a]) for a, (i, _) in enumerate(sets))


def corpus(seed, n, words=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocab) for _ in range(rnd.randrange(3, words))] for _ in range(max(2, n // 8))]
    rows = []
    for i in range(n):
        own = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            own[rnd.randrange(len(own))] = rnd.choice(vocab)
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_equals_comparing_all_pairs(spark, tile):
    rows = corpus(tile, 160)
    got = J.join(spark.createDataFrame(rows, "doc_id bigint, text string"), tile_texts=tile).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)


def test_table_equals_comparing_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.op7_ngram_jaccard(spark, SMALL).collect()) == want
    kept = J.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c, _ in want})


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(4)
    need = J.needed(0.8)
    assert all(need[n] <= 0.8 * n for n in need) and list(need) == sorted(need)
    base = rng.integers(0, 1 << 63, 900, np.uint64)
    for kept in (1.0, 0.9, 0.889):  # of the elements, so the similarity is kept / (2 - kept)
        a, b = base[:800], np.concatenate([base[:int(800 * kept)], base[800:800 + 800 - int(800 * kept)]])
        x, y = J.signature(a)[None], J.signature(b)[None]
        found = list(J.candidates(x, y, np.array([800]), np.array([800]), False, 0.8, need))
        assert found and (J.buckets(x) == J.buckets(y)).any()
    far = J.signature(rng.integers(0, 1 << 63, 800, np.uint64))[None]
    assert not list(J.candidates(x, far, np.array([800]), np.array([800]), False, 0.8, need))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 9))
def test_shared_counts_both_ways(n, m, seed):
    rng = np.random.default_rng(seed)
    make = lambda k: [np.unique(rng.integers(0, 30, rng.integers(1, 20)).astype(np.uint64)) for _ in range(k)]
    a, b = make(n), make(m)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m)))
    want = [len(set(a[x].tolist()) & set(b[y].tolist())) for x, y in zip(i, j)]
    assert J.shared_counts(a, b, i, j).tolist() == want
    assert J.shared_counts(a, b, i[:2], j[:2]).tolist() == want[:2]


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.join(odd_docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0),
                          (None, None, 0), (None, None, 0)], key=repr)
    kept = J.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 8
    assert J.join(no_docs).count() == 0 and J.keep_one(no_docs).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if x != r}


def test_bitmap_loses_no_member(spark):
    docs = spark.range(0, 3000).selectExpr("if(id % 50 = 7, null, id * 1234577 - 900000) as doc_id", "cast(id as string) as text")
    ids = docs.where("doc_id is not null and pmod(doc_id, 3) = 0").select("doc_id")
    own = {r[0] for r in ids.collect()}
    bitmap = J.id_bitmap(ids)
    hit, rest = (J.by_bitmap(docs, bitmap, x).collect() for x in (True, False))
    assert own <= {r[0] for r in hit} and len(hit) < len(own) + 20
    assert sorted(r["text"] for r in hit + rest) == sorted(r["text"] for r in docs.collect())
    assert J.by_bitmap(docs, J.id_bitmap(ids.where("false")), True).count() == 0


@pytest.mark.parametrize("tile", [1024, 7])
def test_repeated_ids_are_documents_of_their_own(spark, tile):
    first, second = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, first), (1, second), (1, second), (2, first), (3, second + " b60"), (4, "c d e"), (4, None), (4, "..."),
            (0, second + " b60 b61")] + [(10 + i % 9, t) for i, t in corpus(5, 80)]
    sets = [frozenset(J.shingles(t or "").tolist()) for _, t in rows]
    link = [[a != b and bool(x) and 5 * len(x & y) >= 4 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    part = list(range(len(rows)))
    for _ in rows:
        part = [min([part[a], *(part[b] for b in range(len(rows)) if link[a][b])]) for a in range(len(rows))]
    lowest = {p: min(rows[a][0] for a in range(len(rows)) if part[a] == p) for p in part}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = J.join(df, tile_texts=tile).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == \
        sorted((rows[a][0], lowest[part[a]], sum(link[a])) for a in range(len(rows)))
    kept = [tuple(r) for r in J.keep_one(df, tile_texts=tile).collect()]
    place = {row: part[a] for a, row in enumerate(rows)}
    assert sorted(place[r] for r in kept) == sorted(set(part))
    assert all(r[0] == lowest[place[r]] for r in kept)
