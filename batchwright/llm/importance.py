"""Importance resampling towards a target, on hashed word n-grams.

Features of a text are its words and its pairs of adjacent words; a feature's
bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  No pair is ever put
together as a string to be hashed:

1. A dictionary of distinct words, each between two delimiters, forms an
   Aho-Corasick automaton.  A word's payload is its length, its CRC and the CRC
   of the word with a space after it.
2. One scan of a text emits the payloads in order.  Delimiters bound every
   entry, so each word of the dictionary is emitted once and nothing else is.
3. The payloads of two neighbours compose: the left CRC is moved on by the
   right word's length and joined with the right CRC, which gives the CRC of
   the pair.  All this is integer arithmetic on whole arrays.

The dictionary holds the ``words`` most frequent words of about ``texts``
documents, taken by a hash.  It saves time only: stretches that the scan leaves
out are words beyond the dictionary, whose payload is computed from their
bytes, so every feature of every text counts.

Buckets are counted over all documents and over the target, and give each
bucket a gain; a document's weight is the floored mean of the gains of its
features, and its score adds noise that depends on its id alone.  Ranks come
from a histogram of the scores (whole numbers in a range of less than 200,000,
whatever the input's size) and a window inside each score.

Null texts count as empty and have no words; a null id is hashed as ``null``
and comes last among equal scores.  Repeated rows are documents of their own.
Every input row gives one output row.  With an empty corpus or target the gains
follow from counts of zero.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchwright.llm.common import kept, map_batches, share, stored, table, texts, utf8
from batchwright.llm.decontaminate import words_of

BUCKETS = 10_000
DICTIONARY_WORDS = 1 << 16
DICTIONARY_TEXTS = 8192
LONGEST = 64  # bytes of a dictionary word, and of a shift that has a table

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shift_tables(longest: int = LONGEST) -> np.ndarray:
    """[n, k, v]: what byte v at place k of a CRC becomes when n zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        out[n + 1] = (out[n] >> 8) ^ one[out[n] & 0xFF]
    return out


class Composer:
    """CRCs of concatenations from the CRCs of the parts."""

    def __init__(self) -> None:
        self.tables = shift_tables()

    def moved(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[n, 0, crc & 0xFF] ^ t[n, 1, (crc >> 8) & 0xFF] ^ t[n, 2, (crc >> 16) & 0xFF] ^ t[n, 3, crc >> 24]

    def joined(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC of left + right, where ``size`` is the number of bytes on the right."""
        left, rest = left.copy(), size.copy()
        while (far := rest > LONGEST).any():
            left[far] = self.moved(left[far], np.full(int(far.sum()), LONGEST))
            rest[far] -= LONGEST
        return self.moved(left, rest) ^ right


class Scanner:
    """Buckets of a text's features, by the dictionary's automaton."""

    def __init__(self, words: list[bytes], buckets: int = BUCKETS):
        import ahocorasick

        self.buckets = np.uint32(buckets)
        self.compose = Composer()
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            # one character a byte, so that offsets and lengths are in bytes
            self.found.add_word(f" {w.decode('latin-1')} ", i)
        if words:
            self.found.make_automaton()
        self.size, self.crc, self.spaced = payloads(words)

    def emitted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, CRC and CRC before a space of every word, in order."""
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        if not len(self.size):
            return payloads(words)
        hits = np.fromiter(chain.from_iterable(self.found.iter(text)), np.int64).reshape(-1, 2)
        which = hits[:, 1]
        got = self.size[which], self.crc[which], self.spaced[which]
        if len(which) == len(words):
            return got
        # the stretches between two emitted words hold the words of no entry
        ends = np.concatenate([[0], hits[:, 0]])
        starts = np.concatenate([hits[:, 0] - self.size[which] - 1, [len(text) - 1]])
        places, others = [], []
        for at in np.flatnonzero(ends != starts).tolist():
            own = text[ends[at] + 1:starts[at]].encode("latin-1").split()
            places += [at] * len(own)
            others += own
        return tuple(np.insert(a, places, b) for a, b in zip(got, payloads(others)))

    def features(self, words: list[bytes]) -> np.ndarray:
        size, crc, spaced = self.emitted(words)
        pairs = self.compose.joined(spaced[:-1], crc[1:], size[1:])
        return np.concatenate([crc, pairs]) % self.buckets


def payloads(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    crc = [zlib.crc32(w) for w in words]
    return (np.array([len(w) for w in words], np.int64), np.array(crc, np.uint32),
            np.array([zlib.crc32(b" ", c) for c in crc], np.uint32))


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS, sample: int = DICTIONARY_TEXTS) -> list[bytes]:
    """The most frequent words of about ``sample`` documents, at most ``words`` of them."""
    n = docs.count()
    some = docs.where(share(["doc_id", "text"], 12) < F.lit(min(1.0, sample / max(1, n))))
    word = F.explode(F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), r'{WORD}', 0)"))
    top = some.select(word.alias("word")).where(F.octet_length("word") <= LONGEST).groupBy("word").count() \
        .orderBy(F.desc("count"), "word").limit(words)
    return [r["word"].encode() for r in top.collect()]


class Buckets:
    """A broadcast dictionary, and the two passes that use it."""

    def __init__(self, spark: SparkSession, words: list[bytes], buckets: int = BUCKETS):
        self.buckets = buckets
        self.words = spark.sparkContext.broadcast(words)
        self.name = f"importance:{spark.sparkContext.applicationId}:{self.words._jbroadcast.id()}"

    def __getstate__(self):
        return self.buckets, self.words, self.name

    def __setstate__(self, state):
        self.buckets, self.words, self.name = state

    def scanner(self) -> Scanner:
        return kept(self.name, lambda: Scanner(self.words.value, self.buckets))

    def count(self, docs: DataFrame) -> np.ndarray:
        """Features of all texts by bucket: summed in each task, then over tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan, n = self.scanner(), np.zeros(self.buckets, np.int64)
            for b in batches:
                for t in utf8(b):
                    if words := words_of(t):
                        n += np.bincount(scan.features(words), minlength=self.buckets)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

        out = np.zeros(self.buckets, np.int64)
        for r in map_batches(docs, run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r["bucket"]] = r["n"]
        return out

    def weigh(self, docs: DataFrame, gains: np.ndarray) -> DataFrame:
        """(doc_id, n_words, n_features, weight) of every row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = self.scanner()
            for b in batches:
                rows = []
                for t in utf8(b):
                    words = words_of(t)
                    f = scan.features(words) if words else ()
                    rows.append((len(words), len(f), int(gains[f].sum()) // len(f) if words else 0))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols],
                                                 ["doc_id", "n_words", "n_features", "weight"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return map_batches(docs, run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of shares, by bucket."""
    n = len(own)
    s_all, t_all = float(own.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(own.tolist(), target.tolist())], np.int64)


def noisy(weighed: DataFrame, seed: int = 7) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """Adds ``rank``: 1, 2, ... of the ``percent`` of the rows with enough words
    that score highest; null for others.  ``scored`` should be stored: it is read three times."""
    usable = F.col("n_words") >= min_words
    sizes = stored(scored.where(usable).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "importance-scores")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    wanted = percent * total // 100
    # scores are whole numbers of a bounded range, so this one window is bounded too
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = stored(sizes.withColumn("ahead", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("ahead") < wanted)
                   .select("score", "ahead"), "importance-drawn")
    least = ahead.agg(F.min("score")).first()[0]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    drawn = usable & (F.col("score") >= least)
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "n_words")
    place = F.col("ahead") + F.row_number().over(inside)
    ranked = scored.where(drawn).join(ahead, "score").withColumn("rank", place) \
        .withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    others = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*others.columns).unionByName(others)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", percent: int = 25, min_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS, words: int = DICTIONARY_WORDS, sample: int = DICTIONARY_TEXTS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``."""
    own = texts(docs, id_col, text_col)
    like = target.select(F.lit(None).cast("string").alias("doc_id"), F.col(target_text).alias("text"))
    scan = Buckets(docs.sparkSession, dictionary(own, words, sample), buckets)
    gains = gains_of(scan.count(own), scan.count(like))
    return draw(stored(noisy(scan.weigh(own, gains), seed), "importance-scored"), percent, min_words)


def brute_force(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) by hashing every feature's bytes (for tests)."""
    import hashlib

    def features(text):
        w = words_of((text or "").encode())
        return [zlib.crc32(x) % BUCKETS for x in w + [a + b" " + b for a, b in zip(w, w[1:])]], len(w)

    own, like = [0] * BUCKETS, [0] * BUCKETS
    for count, rows in ((own, [t for _, t in docs]), (like, target)):
        for t in rows:
            for b in features(t)[0]:
                count[b] += 1
    s_all, t_all = sum(own) + BUCKETS, sum(like) + BUCKETS
    out, can = [], []
    for i, text in docs:
        f, n = features(text)
        g = sum(math.floor(1000 * math.log((like[b] + 1) * s_all / ((own[b] + 1) * t_all))) for b in f)
        weight = g // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if n >= 20:
            can.append((-score, i is None, i or 0, len(f), len(out)))
        out.append([i, len(f), weight, score, None])
    for rank, x in enumerate(sorted(can)[:25 * len(can) // 100], 1):
        out[x[-1]][4] = rank
    return [tuple(x) for x in out]


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_CRC = """xor(list_reduce(flatten(list_transform(range(1, 2 * octet_length(encode({0})), 2), lambda i:
    [CAST('0x' || substr(hex(encode({0})), i, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), 4294967295), 4294967295)"""

ORACLES = {"op12_importance": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), df AS (
  SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d
), bf AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b
), crc AS MATERIALIZED (
  SELECT f, """ + _CRC.format("f") + r""" % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)
), own AS (
  SELECT bucket, count(*) AS s FROM df JOIN crc USING (f) GROUP BY bucket
), goal AS (
  SELECT bucket, count(*) AS t FROM bf JOIN crc USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM own) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM goal) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM own FULL JOIN goal USING (bucket)
), weighed AS (
  SELECT k, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
  FROM df JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY k
), scored AS (
  SELECT k, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)
      AS BIGINT) + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (k)
), ranked AS (
  SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (k)
"""}
