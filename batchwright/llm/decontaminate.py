"""Benchmark decontamination with a generalised suffix automaton.

The items' words, as numbers, go into one suffix automaton.  Each document's
words stream through it once; at every word the automaton knows the longest
stretch ending there that occurs inside some item.  Where that length reaches
``window`` words, those words are hit, and the state shortened to ``window``
words names the items.  Items shorter than a window count as one window.

Items, once each, are dealt by hash into blocks of about ``block_words`` words, and only
one block's automaton is broadcast at a time.  With more than one block the
documents pass once per block, and carry along the hits found so far.

Null texts have no words; a null item id is listed as ``null``; items without
words match nothing.  Every input row gives one output row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.llm.common import map_batches, stored, table, texts, utf8

WINDOW = 13
BLOCK_WORDS = 200_000

#: ASCII letters lowered; every byte that is no part of a word becomes a space.
WORD_BYTES = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: The same words in the text as it stands, for their offsets.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

CARRIED = T.StructType().add("n_words", T.LongType()).add("hits", T.ArrayType(
    T.StructType().add("start", T.LongType()).add("end", T.LongType()))).add("items", T.ArrayType(T.StringType()))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of items given as (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        coded = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items if ws]
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items: dict[int, set[str]] = {}          # by the state that holds the window
        self.short: dict[int, list[tuple[int, str]]] = {}  # by the state that holds the whole item
        for i, ws in coded:
            state = 0
            for n, w in enumerate(ws, 1):
                state = self.step[state][w]
                if n >= window:
                    while self.size[self.link[state]] >= window:
                        state = self.link[state]
                    self.items.setdefault(state, set()).add(i)
            if len(ws) < window:
                self.short.setdefault(state, []).append((len(ws), i))
        # nearest state with a short item, from a state through its suffix links
        self.nearest = [0] * len(self.step)
        if self.short:
            for state in sorted(range(1, len(self.step)), key=self.size.__getitem__):
                self.nearest[state] = state if state in self.short else self.nearest[self.link[state]]

    def _extend(self, last: int, w: int) -> int:
        step, link, size = self.step, self.link, self.size
        if (q := step[last].get(w)) is not None:  # the word was seen after this state: split or reuse
            return q if size[q] == size[last] + 1 else self._clone(last, q, w)
        new = self._state({}, 0, size[last] + 1)
        while last >= 0 and w not in step[last]:
            step[last][w] = new
            last = link[last]
        if last >= 0:
            q = step[last][w]
            link[new] = q if size[q] == size[last] + 1 else self._clone(last, q, w)
        return new

    def _clone(self, p: int, q: int, w: int) -> int:
        new = self._state(dict(self.step[q]), self.link[q], self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _state(self, step: dict[int, int], link: int, size: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.step) - 1

    def stream(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit stretches of word numbers (end exclusive, in order, merged), and the items."""
        step, link, size, window, short = self.step, self.link, self.size, self.window, self.short
        hits: list[list[int]] = []
        items: set[str] = set()
        state = n = 0
        for at, w in enumerate(map(self.number.get, words)):
            if w is None:
                state = n = 0
                continue
            while (to := step[state].get(w)) is None and state:
                state = link[state]
                n = size[state]
            if to is None:
                continue
            state = to
            n += 1
            found = 0
            if n >= window:
                top = state
                while size[link[top]] >= window:
                    top = link[top]
                items |= self.items[top]
                found = window
            if short:
                s = self.nearest[state]
                while s:
                    for k, i in short[s]:
                        if s != state or n >= k:
                            items.add(i)
                            found = max(found, k)
                    s = self.nearest[link[s]]
            if found:
                join(hits, at + 1 - found, at + 1)
        return hits, items


def join(hits: list[list[int]], start: int, end: int) -> None:
    """Add a stretch that ends last to an ordered list of separate stretches."""
    while hits and hits[-1][1] >= start:
        start = min(start, hits.pop()[0])
    hits.append([start, end])


def union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Both lists' stretches, merged.  Stretches that only touch merge too."""
    out: list[list[int]] = []
    for s, e in sorted(a + b):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def count_blocks(items: DataFrame, block_words: int) -> int:
    # a word and its separator are two bytes at least
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / 2 / block_words))


def blocks(items: DataFrame, n: int, window: int) -> Iterator[Automaton]:
    """One automaton per block of (doc_id, text); each block's items are collected on their own."""
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == k).collect()
        got = [("null" if r[0] is None else str(r[0]), words_of(r[1].encode())) for r in rows]
        if got or not k:
            yield Automaton(got, window)


def merged(b: pa.RecordBatch, automaton: Automaton) -> Iterator[tuple[int, list[list[int]], list[str]]]:
    before_hits, before_items = b.column("hits").to_pylist(), b.column("items").to_pylist()
    for text, h, i in zip(utf8(b), before_hits, before_items):
        words = words_of(text)
        hits, items = automaton.stream(words)
        if h:
            hits = union(hits, [[x["start"], x["end"]] for x in h])
        yield len(words), hits, sorted(items.union(i or ()))


def stretches(lists: list[list[list[int]]]) -> pa.Array:
    flat = [x for hits in lists for x in hits]
    offsets = [0]
    for hits in lists:
        offsets.append(offsets[-1] + len(hits))
    values = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.int64()),
                                         pa.array([e for _, e in flat], pa.int64())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """(doc_id, [text], n_words, hits, items): ``hits`` are stretches of word
    numbers inside occurrences of windows, ``items`` the sorted ids as strings."""
    spark = docs.sparkSession
    df = texts(docs, id_col, text_col).selectExpr(
        "doc_id", "text", "cast(0 as bigint) n_words",
        "cast(null as array<struct<start:bigint,end:bigint>>) hits", "cast(null as array<string>) items")

    def one_pass(df: DataFrame, automaton: Broadcast, text: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = automaton.value
            for b in batches:
                got = list(merged(b, a))
                cols = {"doc_id": b.column("doc_id")} | ({"text": b.column("text")} if text else {})
                cols |= {"n_words": pa.array([x[0] for x in got], pa.int64()), "hits": stretches([x[1] for x in got]),
                         "items": pa.array([x[2] for x in got], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        own = [df.schema[c] for c in (["doc_id", "text"] if text else ["doc_id"])]
        return map_batches(df, run, T.StructType(own + CARRIED.fields))

    # a repeated item would fall into one block as often as it is there
    items = stored(texts(items, "item_id").where(F.col("text").isNotNull()).distinct(), "decontaminate-items")
    waiting = None
    for a in blocks(items, count_blocks(items, block_words), window):
        if waiting is not None:
            df = stored(one_pass(df, waiting, True), "decontaminate")
        waiting = spark.sparkContext.broadcast(a)
    return one_pass(df, waiting, keep_text)


def verdict(found: DataFrame, coverage: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: at least one word in ``coverage`` is hit."""
    n_hit = F.expr("aggregate(hits, cast(0 as bigint), (n, x) -> n + x.end - x.start)")
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", F.expr(f"n_hit > 0 and {coverage} * n_hit >= n_words"))


def cut(text: str, hits: list[tuple[int, int]], min_words: int) -> str:
    """The text without the stretches of at least ``min_words`` words."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for s, e in hits:
        if e - s >= min_words:
            out.append(text[last:at[s][0]])
            last = at[e - 1][1]
    return "".join(out) + text[last:]


def remove_spans(docs: DataFrame, items: DataFrame, min_words: int = WINDOW, coverage: int = 20,
                 **options) -> DataFrame:
    """(doc_id, text) of documents within the coverage limit, without hit
    stretches of ``min_words`` or more; documents beyond it are left out."""
    found = verdict(matches(docs, items, keep_text=True, **options), coverage).where("not contaminated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if not h else cut(t, [(x["start"], x["end"]) for x in h], min_words)
                   for t, h in zip(b.column("text").to_pylist(), b.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_batches(found.select("doc_id", "text", "hits"), run, f"doc_id {kind}, text string")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW,
               coverage: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, with all their columns, of documents that are not contaminated.

    Each row goes by its own text, whatever ids are null or repeated: the other
    columns pass through all blocks with the text, in the place of the id."""
    others = [c for c in docs.columns if c != text_col] or [text_col]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in others]).alias("row"), docs[f"`{text_col}`"].alias("text"))
    found = matches(rows, items, "row", window=window, block_words=block_words, keep_text=True)
    return verdict(found, coverage).where("not contaminated").select(
        *[F.col("text").alias(c) if c == text_col else F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def brute_force(words: list[bytes], items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> tuple[int, str]:
    """n_hit and items_sha256 by comparing every window at every place (for tests)."""
    hit, ids = set(), set()
    for i, ws in items:
        k = min(window, len(ws))
        grams = {tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)} if k else set()
        for j in range(len(words) - k + 1):
            if k and tuple(words[j:j + k]) in grams:
                ids.add(i)
                hit.update(range(j, j + k))
    return len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdict(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES = {"op6_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT item, k, array_to_string(w[j:j + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)
), p AS (
  SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), m AS (
  SELECT doc_id, item, k, j FROM p JOIN g USING (k, gram)
), h AS (
  SELECT doc_id, count(DISTINCT n) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS n FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""}
