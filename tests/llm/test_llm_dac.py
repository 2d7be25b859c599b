import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from batchwright.llm import dac as X
from batchwright.session import scratch_path
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(X.VOCABULARY)


with open(PATH, encoding="utf-8") as file:
    VOCABULARY = file.read()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 70_000) | st.integers(0, 255), max_size=1500),
       st.data())
def test_random_access_and_slices(ids, data):
    ids = np.array(ids, np.uint32)
    cut = data.draw(st.integers(0, len(ids)))
    r = X.Reader(io.BytesIO(X.file_bytes([None, 9], [cut, len(ids) - cut], ids)))
    docs, starts = r.documents()
    assert docs == [None, 9] and starts.tolist() == [0, cut, len(ids)]
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert r.slice(a, b).tolist() == ids[a:b].tolist()
    for i in data.draw(st.lists(st.integers(0, max(0, len(ids) - 1)), max_size=20)) if len(ids) else []:
        assert r.get(i) == ids[i]
    with pytest.raises(IndexError):
        r.get(len(ids))


TEXT = st.text(max_size=60) | st.text("aBcé \n\t\r ́'sllt.19|<>", max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_stretches_between_spaces_encode_as_the_whole(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    for by_spaces in (True, False):
        assert np.frombuffer(X.id_bytes("t", VOCABULARY, text, by_spaces), "<u4").tolist() == want


TOKENIZER = Tokenizer.from_file(PATH)


def test_new_stretches_take_one_call(monkeypatch):
    memo = X.Memo(VOCABULARY)
    calls = []
    encode = memo.tokenizer.encode

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return encode(text, **options)

    monkeypatch.setattr(X, "kept", lambda name, make: memo)
    memo.tokenizer = Counted()
    text = "Thndhe reou, l'été déjà vu d'où 3x7 naïve-té\nandthe a\u0301b ou. 中文 don't thndhe." + " wor\u00e9d" * 30
    for _ in range(2):
        got = X.id_bytes("t", VOCABULARY, text, True)
        assert np.frombuffer(got, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    # one for all that is new and no plain word, and one for the full stop and the comma each
    assert len(calls) <= 3, calls
    for odd in (f"ab {X.MARK} é{X.MARK}é à{X.MARK}", "é <|endoftext|> à É", "x\x01 é à", "é" * 200 + " à ù"):
        got = X.id_bytes("t", VOCABULARY, odd, True)
        assert np.frombuffer(got, "<u4").tolist() == TOKENIZER.encode(odd, add_special_tokens=False).ids


def expected(rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in X.op3_dac_tokens(spark, SMALL).collect()) == expected(rows)


def test_many_small_files(spark):
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(200)]
    folder = scratch_path(spark, "dac-test")
    manifest = X.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), PATH, folder, max_ids=20)
    assert manifest.count() > 20
    got = X.read(manifest, folder).collect()
    assert sorted((r[0], r[1], len(r[2]) // 4, zlib.crc32(r[2])) for r in got) == expected(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    folder = scratch_path(spark, "dac-test")
    got = sorted(X.read(X.write(odd_docs, PATH, folder), folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6]
    assert [r["start"] for r in got][1:] == np.cumsum([len(r["ids"]) // 4 for r in got]).tolist()[:-1]
    assert all(len(r["ids"]) == 4 for r in got if r["doc_id"] in (2, 3))
    folder = scratch_path(spark, "dac-test")
    assert X.read(X.write(no_docs, PATH, folder), folder).count() == 0


LITERALS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>.", "Go<|endoftext|>On,",
            "<|ENDOFTEXT|><|endoftext|>", "<|endoftext", "Word.", " ", "\n", "\u0301", "\u2003", "19's"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LITERALS), max_size=12))
def test_added_tokens_as_the_library_has_them(parts):
    text = "".join(parts)
    want = UNTOUCHED.encode(text, add_special_tokens=False).ids
    for by_spaces in (True, False):
        assert np.frombuffer(X.id_bytes("t", VOCABULARY, text, by_spaces), "<u4").tolist() == want


UNTOUCHED = Tokenizer.from_file(PATH)


def test_added_tokens_in_files(spark):
    rows = [(1, "One <|endoftext|> two"), (2, "a<|STARTOFTEXT|>b <|startoftext|>"), (3, "three")]
    folder = scratch_path(spark, "dac-test")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in X.read(X.write(docs, PATH, folder, by_spaces=True), folder).collect())
    start, want = 0, []
    for doc_id, text in rows:
        ids = [*UNTOUCHED.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(i, s, bytes(d)) for i, s, d in got] == want
    assert 49407 in np.frombuffer(got[0][2], "<u4") and 49406 in np.frombuffer(got[1][2], "<u4")
