import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from batchwright.llm import bpe as B
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"
PAIRS = B.read_ranks(public_tokenizers.path(B.RANKS))
VOCAB = B.Vocabulary(PAIRS, public_tokenizers.PATTERN)
ENCODER = B.Encoder(VOCAB)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(PAIRS), special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    h = VOCAB.whole
    assert len(h.keys) == len(PAIRS) and all(h.get(k) == v for k, v in PAIRS)
    assert h.get(b"surely no token of this vocabulary") is None


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=80) | st.text("abcdeà  \n'st.1中", max_size=80))
def test_equals_the_library_and_returns(text):
    got = ENCODER.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ORACLE.encode_ordinary(text)
    assert B.bytes_of(got, VOCAB.token) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "thntreor" * 700, "<|endoftext|> x", " " * 3000, "ab" * 3001])
def test_long_matches(text):
    got = ENCODER.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ORACLE.encode_ordinary(text)


WHITE = " |  |\n|\n\n| \n|\n |\t|\u3000|\xa0|\x1c|\r\n|\x85".split("|")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["", "a", "don't", "'s", "été.", "x1", "12", "?!", "中文", *WHITE, " ", " ", " "]), max_size=30))
def test_stretches_between_spaces_encode_as_the_whole(parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ORACLE.encode_ordinary(text)


def test_what_the_pattern_takes_for_white_space():
    import regex

    white = regex.compile(r"\s")
    assert not [i for i in range(0x110000) if white.match(chr(i)) and not chr(i).isspace()]


def test_known_stretches_are_not_split_again():
    own = B.Encoder(VOCAB)
    text = "Thndhe reou, don't andthe\nthe été of.\nAnd so on " * 3
    want = ORACLE.encode_ordinary(text.strip())
    calls = []
    split, own.stretches.split = own.stretches.split, lambda t: calls.append(t) or split(t)
    for _ in range(2):
        assert np.frombuffer(own.encode(text.strip()), "<u4").tolist() == want
        n = len(calls)
    assert n == len(set(calls)) <= 14, calls


def test_memo_may_start_anew(monkeypatch):
    monkeypatch.setattr(B, "MEMO", 3)
    own = B.Encoder(VOCAB)
    text = "several words that do not all fit into so small a memo xqzt brrk"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ORACLE.encode_ordinary(text)


def test_odd_rows(spark, odd_docs, no_docs):
    vocab = B.vocabulary(spark)
    rows = B.round_trip(odd_docs, vocab).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 9 and {r["ids_sha256"] for r in rows if r["doc_id"] in (2, 3)} == {empty}
    for r, t in zip(sorted((r for r in rows if r["doc_id"]), key=lambda r: r["doc_id"]),
                    [d["text"] for d in odd_docs.where("doc_id is not null").orderBy("doc_id").collect()]):
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.round_trip(no_docs, vocab).count() == 0


def test_query(spark):
    rows = {r["doc_id"]: r for r in B.op2_byte_bpe(spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = np.array(ORACLE.encode_ordinary(d["text"] or ""), "<u4")
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def oracle(texts):
    return [np.array(ORACLE.encode_ordinary(t), "<u4").tobytes() for t in texts]


def new_words(n, letters="etaoinshrdluéßñ中", most=14):
    rng = np.random.default_rng(5)
    return ["".join(rng.choice(list(letters), rng.integers(2, most))) for _ in range(n)]


def test_new_matches_of_many_texts_are_merged_together(monkeypatch):
    texts = [" ".join(new_words(2000)[i:i + 50]) + ".\nAnd (so) on" for i in range(0, 2000, 50)]
    want, calls = oracle(texts), []
    merge = B.Vocabulary.merge
    monkeypatch.setattr(B.Vocabulary, "merge", lambda self, piece: calls.append(piece) or merge(self, piece))
    got = B.Encoder(VOCAB).encode_all(texts)
    assert got == want and len(calls) < 4 * B.FEW
    assert [bytes(x).decode() for x in B.all_bytes_of(got, VOCAB.tokens)] == texts


def test_rows_of_bytes_merge_as_the_heap(monkeypatch):
    monkeypatch.setattr(B, "ROOM", 100)
    pieces = [w.encode() for n in (3, 9, 12, 40) for w in new_words(300, most=n)]
    pieces += [b"a" * n for n in range(2, 40)] + [b"ab" * n for n in range(1, 20)] + [bytes([0, i]) for i in range(256)]
    assert VOCAB.merge_all(pieces) == [np.array(VOCAB.merge(p), "<u4").tobytes() for p in pieces]
    assert VOCAB.merge_all([]) == []


def test_whole_matches_looked_up_together():
    keys = [k for k, _ in PAIRS] + [w.encode() for w in new_words(500)] + [b""]
    assert VOCAB.whole.get_all(keys) == [VOCAB.whole.get(k) for k in keys]
    assert VOCAB.whole.get_all([]) == [] and B.PerfectHash([]).get_all([b"a"]) == [None]


def test_pairs_looked_up_together():
    keys = np.array(list(VOCAB.pair), np.int64)
    assert VOCAB.pairs.get(keys >> 32, keys & 0xFFFFFFFF).tolist() == list(VOCAB.pair.values())
    a, b = np.arange(-1, 5000), np.full(5001, B.GONE)
    assert set(VOCAB.pairs.get(a, b)) == set(VOCAB.pairs.get(b, a)) == {B.NEVER}


@pytest.mark.parametrize("parts", [3, 1 << 15])
def test_texts_of_all_kinds_at_once(monkeypatch, parts):
    monkeypatch.setattr(B, "PARTS", parts)
    monkeypatch.setattr(B, "MEMO", 2000)
    texts = ["", " ", "  a", "a ", "\n", "a\n\nb c", "don't 's it", "x  y z" * 9, "été.\n les", "q" * 300 + " end", "\t a b",
             " ".join(new_words(90)), "12 a1 (b) c; d!? e", "中 文 中\u3000文", "a" + " \n" * 5]
    own = B.Encoder(VOCAB)
    assert own.encode_all(texts) == oracle(texts) == [own.encode(t) for t in texts]
    assert own.encode_all([]) == []
    for memo in (own.stretches, own.matches):
        assert not [k for k in memo.now if len(k) > B.MEMO_LETTERS]
        assert sum(B.ENTRY + len(k) for k in memo.now) <= 2000


def test_other_patterns():
    own = B.Encoder(B.Vocabulary(PAIRS, r"[a-z ]+|[^a-z ]+"))
    plain = tiktoken.Encoding("words", pat_str=r"[a-z ]+|[^a-z ]+", mergeable_ranks=dict(PAIRS), special_tokens={})
    texts = ["the end of it", "", "a  b, c\n", "so on" * 20]
    assert own.encode_all(texts) == [np.array(plain.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_letters_and_marks_are_matches():
    import regex

    letter = regex.compile(r"\p{L}")
    assert not [i for i in range(0x110000) if chr(i).isalpha() and not letter.match(chr(i))]
    assert not [m for m in B.MARKS if not regex.fullmatch(r"[^\s\p{L}\p{N}]", m)]
