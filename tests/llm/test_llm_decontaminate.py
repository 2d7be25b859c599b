import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from batchwright.llm import decontaminate as D
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"
LETTERS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.lists(LETTERS, min_size=1, max_size=5), st.integers(1, 6))
def test_stream_equals_comparing_every_window(words, items, window):
    named = [(str(i), ws) for i, ws in enumerate(items)]
    hits, ids = D.Automaton(named, window).stream(words)
    n, digest = D.brute_force(words, named, window)
    assert sum(e - s for s, e in hits) == n
    assert hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest() == digest
    assert all(a[1] < b[0] for a, b in zip(hits, hits[1:]))


def fixture(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 13, 20, 40])))) for i in range(30)]
    items += [(7, items[8][1]), (None, "lone words of an item without an id stand here for everybody to read today ok"), (50, None), (51, "")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rnd.randrange(0, 200))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(own) + 1)
            own[at:at] = rnd.choice(items[:31])[1].upper().split()
        docs.append((i, ", ".join(own)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), docs, items


def test_matches_whatever_the_blocks(spark):
    docs, items, raw, own = fixture(spark)
    named = [("null" if i is None else str(i), D.words_of((t or "").encode())) for i, t in own]
    want = {i: D.brute_force(D.words_of(t.encode()), named) for i, t in raw}
    for block_words in (200_000, 150):
        got = D.verdict(D.matches(docs, items, block_words=block_words)).collect()
        assert {r["doc_id"]: (r["n_hit"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got} == want
        clean = {r["doc_id"] for r in got if not r["contaminated"]}
        assert {r["doc_id"] for r in D.keep_clean(docs, items, block_words=block_words).collect()} == clean
    assert 0 < len(clean) < len(raw)


def test_cut_removes_only_long_stretches():
    text = "One, two three. FOUR five"
    assert D.cut(text, [(1, 3)], 2) == "One, . FOUR five"
    assert D.cut(text, [(1, 3)], 3) == text


def test_remove_spans(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(13)))], "item_id bigint, text string")
    body = " ".join(f"x{i}" for i in range(400))
    docs = spark.createDataFrame([(1, body + " " + " ".join(f"W{i}" for i in range(13)) + " tail"), (2, " ".join(f"w{i}" for i in range(13)))],
                                 "doc_id bigint, text string")
    assert [tuple(r) for r in D.remove_spans(docs, items).collect()] == [(1, body + "  tail")]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten one two three"), (None, None)],
                                  "item_id bigint, text string")
    rows = D.verdict(D.matches(odd_docs, items)).collect()
    assert len(rows) == 9 and {r["doc_id"] for r in rows if r["contaminated"]} == {4}
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    assert len(D.keep_clean(odd_docs, items).collect()) == 8
    assert D.matches(no_docs, items).count() == 0
    none = items.where("false")
    assert not any(r["n_hit"] for r in D.verdict(D.matches(odd_docs, none)).collect())


def test_query(spark):
    items = [(str(r["item_id"]), D.words_of(r["text"].encode())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in D.op6_decontaminate(spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n, digest = D.brute_force(D.words_of(d["text"].encode()), items)
        r = rows[d["doc_id"]]
        assert (r["n_hit"], r["items_sha256"]) == (n, digest)
        assert r["contaminated"] == (n > 0 and 20 * n >= r["n_words"])


def test_keep_clean_goes_by_row_whatever_the_blocks(spark):
    docs, items, raw, own = fixture(spark)
    named = [("null" if i is None else str(i), D.words_of((t or "").encode())) for i, t in own]
    rows = [(None if i % 3 == 0 else i % 4, t, f"row {i}", i) for i, t in raw] + [(None, None, "null text", 99)]
    want = set()
    for row in rows:
        words = D.words_of((row[1] or "").encode())
        n = D.brute_force(words, named)[0]
        if not (n and 20 * n >= len(words)):
            want.add(row)
    bad = {r[0] for r in set(rows) - want}
    assert None in bad and bad & {r[0] for r in want}
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, items string, `n.words` int")
    for block_words in (200_000, 150):
        got = D.keep_clean(odd, items, block_words=block_words)
        assert got.columns == odd.columns
        kept = got.collect()
        assert len(kept) == len(want) and {tuple(r) for r in kept} == want


def test_repeated_items_are_collected_once(spark, monkeypatch):
    docs, items, raw, own = fixture(spark)
    sizes = []

    init = D.Automaton.__init__

    def counting(self, named, window):
        sizes.append(len(named))
        init(self, named, window)

    def result(rows):
        sizes.clear()
        got = D.matches(docs, spark.createDataFrame(rows, items.schema), block_words=150).collect()
        return sorted((r["doc_id"], r["n_words"], repr(r["hits"]), r["items"]) for r in got), list(sizes)

    monkeypatch.setattr(D.Automaton, "__init__", counting)
    once = result(own)
    assert len(once[1]) > 1 and sum(once[1]) == len({r for r in own if r[1] is not None})
    assert result(own + own[:1] * 400) == once
