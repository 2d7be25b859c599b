"""Ranked lexical search with pair-bound MaxScore.

Every document is scored for every item by the sum, over the item's terms, of a
whole-number impact: the term's weight times a saturated frequency that longer
documents lower.  Only the ``k`` best of each item are wanted, so most
documents never need a full score:

1. *Profiles.*  One pass finds the length of every document and how often it
   holds the items' terms; counts over all documents give the weights.
2. *Index.*  Documents are dealt into blocks of bounded size, each one row of a
   stored table: for every term a list of (document, impact) and the largest
   impact; for pairs of terms that items hold together the intersection of
   the two lists and the largest joint impact.
3. *Search.*  A task goes through its blocks with a list of the ``k`` best of
   each item, whose last score is the threshold.  An item's terms are taken in
   pairs; a pair can add at most its joint maximum, or the larger of the two
   single maxima, often less than the two together.  From the smallest bound
   on, pairs whose bounds sum up below the threshold are optional: a document
   that holds no other term cannot enter the list, and candidates are dropped
   as soon as what they have and the bounds left fall below the threshold.
   A task without a threshold takes one from the best pairs' intersections.
4. Lists of all tasks merge by item.

Items go in blocks of about ``block_words`` words, once each over the corpus,
so the terms that are broadcast are bounded.  Profiles hold one entry per
document and term of the items.

Terms are words with A-Z lowered.  Rows that share an item id form one item,
null being an id too; an item without terms has no results.  Null texts have
no terms and are no documents.  Repeated rows are documents of their own, and
null ids come last among equal scores.  Document ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.llm.common import kept, map_batches, stored, table, utf8
from batchwright.llm.decontaminate import words_of

BLOCK_WORDS = 4_000_000
BLOCK_DOCS = 2048
BLOCK_POSTINGS = 1 << 19

PROFILE = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
INDEX = ("docs array<bigint>, terms binary, ends binary, places binary, impacts binary, tops binary, "
         "pairs binary, pair_ends binary, pair_places binary, joint binary")


class Items:
    """One block of items: their ids, their terms and the pairs of terms."""

    def __init__(self, rows: list[tuple[object, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.number: dict[bytes, int] = {}
        self.terms = [np.array([self.number.setdefault(w, len(self.number)) for w in ws], np.int64) for _, ws in rows]

    def pair_up(self, df: np.ndarray) -> None:
        """Pair the terms of each item in the order of how many documents hold
        them: frequent ones, whose lists are long, meet each other."""
        self.pairs: list[tuple[int, int]] = []
        known: dict[tuple[int, int], int] = {}
        self.units = []  # per item: left terms, right terms, numbers of the pairs; then a term left over
        for terms in self.terms:
            order = terms[np.lexsort((terms, -df[terms]))]
            half = len(order) // 2
            a, b = order[0:2 * half:2], order[1:2 * half:2]
            own = []
            for pair in zip(a.tolist(), b.tolist()):
                if pair not in known:
                    known[pair] = len(self.pairs)
                    self.pairs.append(pair)
                own.append(known[pair])
            self.units.append((a, b, np.array(own, np.int64), order[2 * half:]))


class Shared:
    """A broadcast value with a name that stays the same between tasks."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.data.value


def item_blocks(items: DataFrame, block_words: int) -> Iterator[Items]:
    """(item_id, text) by hash of the id; each block's terms are collected on their own."""
    items = stored(items.where(F.col("text").isNotNull()).distinct(), "lexical-items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / 2 / block_words))
    for k in range(n):
        terms: dict[object, dict[bytes, None]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect():
            terms.setdefault(r["item_id"], {}).update(dict.fromkeys(words_of(r["text"].encode())))
        yield Items([(i, sorted(t)) for i, t in sorted(terms.items(), key=lambda x: (x[0] is None, str(x[0]))) if t])


def profiles(docs: DataFrame, items: Shared) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with terms; ``terms`` are numbers of the items' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.number.get
        for b in batches:
            ids, sizes, offsets, terms, counts = [], [], [0], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), utf8(b)):
                words = words_of(text)
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                ids.append(i)
                sizes.append(len(words))
                terms += found.keys()
                counts += found.values()
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists],
                                             ["doc_id", "n", "terms", "counts"])

    return map_batches(docs, run, PROFILE)


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms of all documents, and by the items' terms how many documents hold each."""
    n, size = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(n_terms, np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    return n, size or 0, df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def raw(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def index(found: DataFrame, n: int, size: int, weight: np.ndarray, pairs: list[tuple[int, int]],
          block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """One row per block of profiles: term lists, pair lists and their largest impacts."""
    shared = Shared(found.sparkSession, (weight, np.array(pairs, np.int64).reshape(-1, 2)))

    def block(ids: list, sizes: list[np.ndarray], held: list[np.ndarray], terms: list[np.ndarray],
              counts: list[np.ndarray]) -> pa.RecordBatch:
        w, pairs = shared.value
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.int64)
        m = 100 - 50 + (50 * np.concatenate(sizes) * n) // size
        place = np.repeat(np.arange(len(ids)), np.concatenate(held))
        impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
        order = np.argsort(term, kind="stable")
        term, place, impact = term[order], place[order], impact[order]
        own, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term))
        tops = np.maximum.reduceat(impact, starts) if len(term) else impact
        at = np.full(len(w), -1)
        at[own] = np.arange(len(own))
        # a pair's lists meet in one array over the block's documents
        left, here = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        met, joint, pair_places, pair_ends = [], [], [], []
        both = np.flatnonzero((at[pairs[:, 0]] >= 0) & (at[pairs[:, 1]] >= 0))
        for p in both.tolist():
            a, b = at[pairs[p, 0]], at[pairs[p, 1]]
            pa_, pb = place[starts[a]:ends[a]], place[starts[b]:ends[b]]
            left[pa_], here[pa_] = impact[starts[a]:ends[a]], True
            inside = here[pb]
            if inside.any():
                common = pb[inside]
                met.append(p)
                joint.append(int((left[common] + impact[starts[b]:ends[b]][inside]).max()))
                pair_places.append(common)
                pair_ends.append(len(common))
            here[pa_] = False
        row = [raw(own, "<i4"), raw(ends, "<i4"), raw(place, "<i4"), raw(impact, "<i8"), raw(tops, "<i8"), raw(met, "<i4"),
               raw(np.cumsum(pair_ends), "<i4"), raw(np.concatenate(pair_places) if met else [], "<i4"), raw(joint, "<i8")]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in row],
                                          [f.split()[0] for f in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: tuple[list, ...] = ([], [], [], [], [])
        postings = 0
        for b in batches:
            held = np.diff(b.column("terms").offsets.to_numpy())
            terms, counts = (b.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            part[0].extend(b.column("doc_id").to_pylist())
            for to, x in zip(part[1:], (b.column("n").to_numpy(), held, terms, counts)):
                to.append(x)
            postings += len(terms)
            if len(part[0]) >= block_docs or postings >= block_postings:
                yield block(*part)
                part, postings = ([], [], [], [], []), 0
        if part[0]:
            yield block(*part)

    return map_batches(found, run, INDEX, max(1, min(64, block_docs)))


class Block:
    """One row of the index, laid out by the numbers of terms and pairs."""

    def __init__(self, row: dict, n_terms: int, n_pairs: int):
        read = {c: np.frombuffer(row[c], k) for c, k in (
            ("terms", "<i4"), ("ends", "<i4"), ("places", "<i4"), ("impacts", "<i8"), ("tops", "<i8"),
            ("pairs", "<i4"), ("pair_ends", "<i4"), ("pair_places", "<i4"), ("joint", "<i8"))}
        self.size = len(row["docs"])
        self.ids = np.array([x or 0 for x in row["docs"]], np.int64)
        self.lone = np.array([x is None for x in row["docs"]])
        self.places, self.impacts, self.pair_places = read["places"], read["impacts"], read["pair_places"]
        self.start, self.end = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        self.top, self.joint = np.zeros(n_terms, np.int64), np.zeros(n_pairs, np.int64)
        self.start[read["terms"]] = np.append(0, read["ends"])[:-1]
        self.end[read["terms"]] = read["ends"]
        self.top[read["terms"]] = read["tops"]
        self.joint[read["pairs"]] = read["joint"]
        self.pair_start, self.pair_end = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
        self.pair_start[read["pairs"]] = np.append(0, read["pair_ends"])[:-1]
        self.pair_end[read["pairs"]] = read["pair_ends"]
        self.sums = np.zeros(self.size, np.int64)

    def add(self, term: int, only: np.ndarray | None = None) -> None:
        """The term's impacts to the sums of all documents, or at least of ``only``."""
        places, impacts = self.places[self.start[term]:self.end[term]], self.impacts[self.start[term]:self.end[term]]
        if only is None or 4 * len(only) > len(places):
            self.sums[places] += impacts
        elif len(places):
            at = np.minimum(np.searchsorted(places, only), len(places) - 1)
            same = places[at] == only
            self.sums[only[same]] += impacts[at[same]]


class Best:
    """The k best documents of one item so far: larger scores, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.lone = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def needed(self) -> int:
        """The least score that could still enter the list."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def merge(self, score: np.ndarray, ids: np.ndarray, lone: np.ndarray) -> None:
        score, ids, lone = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.lone, lone)))
        order = np.lexsort((ids, lone, -score))[:self.k]
        self.score, self.ids, self.lone = score[order], ids[order], lone[order]


def seed(block: Block, unit: tuple, k: int) -> int:
    """A score that k documents reach, from the intersections of the best pairs; 1 if they hold fewer."""
    a, b, pair, odd = unit
    some: list[np.ndarray] = []
    for p in pair[np.argsort(-block.joint[pair], kind="stable")].tolist():
        some.append(block.pair_places[block.pair_start[p]:block.pair_end[p]])
        if sum(map(len, some)) >= 2 * k:
            break
    docs = np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)
    if len(docs) < k:
        return 1
    block.sums[:] = 0
    for t in np.concatenate([a, b, odd]).tolist():
        block.add(t, docs)
    return max(1, int(np.partition(block.sums[docs], len(docs) - k)[len(docs) - k]))


def answer(block: Block, unit: tuple, best: Best) -> int:
    """Merge the block's documents into an item's list; returns how many got a full score."""
    a, b, pair, odd = unit
    bound = np.concatenate([np.maximum(np.maximum(block.top[a], block.top[b]), block.joint[pair]), block.top[odd]])
    order = np.argsort(bound, kind="stable")
    total = np.cumsum(bound[order])
    needed = best.needed
    if total[-1] < needed:
        return 0
    if needed == 1:
        needed = seed(block, unit, best.k)
    optional = int(np.searchsorted(total, needed, "left"))  # units whose bounds sum up below what is needed
    members = [(x, y) for x, y in zip(a.tolist(), b.tolist())] + [(x,) for x in odd.tolist()]
    block.sums[:] = 0
    for u in order[optional:].tolist():
        for t in members[u]:
            block.add(t)
    docs = np.flatnonzero(block.sums)
    for j in range(optional - 1, -1, -1):
        docs = docs[block.sums[docs] + total[j] >= needed]
        if not len(docs):
            return 0
        for t in members[order[j]]:
            block.add(t, docs)
    docs = docs[block.sums[docs] >= needed]
    best.merge(block.sums[docs], block.ids[docs], block.lone[docs])
    return len(docs)


def ranked(blocks: DataFrame, items: Shared, k: int, id_type: T.DataType) -> DataFrame:
    """(item_id, rank, doc_id, score) from the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        best = [Best(k) for _ in own.ids]
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, len(own.number), len(own.pairs))
                for unit, top in zip(own.units, best):
                    answer(block, unit, top)
        for i, top in zip(own.ids, best):
            n = len(top.score)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, T_ARROW), pa.array(top.ids, mask=top.lone), pa.array(top.score)],
                    ["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    T_ARROW = to_arrow_type(id_type)
    schema = T.StructType().add("item_id", id_type).add("doc_id", T.LongType()).add("score", T.LongType())
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return map_batches(blocks, run, schema, 1).withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
           block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents that score highest, above 0."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    parts = []
    for block in item_blocks(asked, block_words):
        found = stored(profiles(own, Shared(spark, block)), "lexical-profiles")
        n, size, df = statistics(found, len(block.number))
        block.pair_up(df)
        blocks = stored(index(found, n, size, weights(n, df), block.pairs, block_docs, block_postings), "lexical-index")
        parts.append(ranked(blocks, Shared(spark, block), k, asked.schema["item_id"].dataType))
        if len(parts) > 1:  # one block at a time, so that one set of terms is in use
            parts = [stored(parts[0], "lexical"), stored(parts[1], "lexical")]
            parts = [parts[0].unionByName(parts[1])]
    return parts[0]


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES = {"op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (
  SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS size FROM docs
), held AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM docs) GROUP BY k, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM held, total GROUP BY term, n_docs
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // size)))) AS score
  FROM items JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (k), total GROUP BY item_id, k
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
  doc_id, CAST(score AS BIGINT) AS score
FROM scored JOIN docs USING (k) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""}
