"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two texts are linked when the Jaccard similarity of their sets of five-word
shingles is at least 0.8 (words lower-cased; a shorter text is one shingle).

1. Texts with equal sets (by 128-bit digest) form a class with a number of its
   own; one text goes on for it, that of the smallest id and text hash.
2. MinHash values of a class, six at a time, name ``BANDS`` buckets.  A pair at
   exactly the threshold shares none of them with a chance of 1e-7, and a more
   similar one with far less.  Edges from a bucket's smallest member to the
   others give candidate components; linked classes are in the same one.
3. A component's members meet in tiles, blocks by blocks of a bounded number
   of texts and shingles, so a large component is many tasks.  In a tile,
   MinHash values are compared 32 at a time; a pair is dropped once the
   posterior probability (uniform prior) that it reaches the threshold falls
   below ``TOLERANCE``.  What stays is verified by exact set intersection.
4. A tile emits, for each text, its number of links (counting copies) and the
   first class that it reaches there: never a list of pairs.  Components of
   those edges are the result's classes.

Result: one row per input row: doc_id, class_id (smallest doc_id of the
connected texts), n_links (other documents at or above the threshold).

Null texts, and texts without words, have no shingles: they are in a class of
their own, without links.  A null doc_id has a null class and no links, and
takes no part.  Rows that repeat a doc_id count as documents of their own with
that id; their texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import kept, map_batches, ship, stored, strings, table, texts
from batchwright.llm.components import components

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 53
HASHES = ROWS * BANDS
STEP = 32
TOLERANCE = 1e-9
TILE_TEXTS, TILE_SHINGLES = 1024, 1 << 20
TASK_TEXTS = 4096       # texts of tiles in one task, about
BITS, BITMAP = 1 << 26, 1 << 15  # of the members' bitmap, and of one of its parts
MEMO = 1 << 17
CHUNK = 512

#: Digits, ASCII letters and all bytes beyond ASCII make up words.
WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
RNG = np.random.default_rng(20)
XOR = RNG.integers(0, 1 << 32, HASHES, np.uint32)[:, None]
MUL = RNG.integers(0, 1 << 32, HASHES, np.uint32)[:, None] | np.uint32(1)
SALT = RNG.integers(0, 1 << 63, BANDS, np.uint64)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * MIX[0]
        x = (x ^ (x >> np.uint64(29))) * MIX[1]
        return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(kept("jaccard", WordHash).__getitem__, found)), np.uint64)
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out ^ h[i:i + n])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), CHUNK):
            x = low[None, i:i + CHUNK] ^ XOR
            np.multiply(x, MUL, out=x)
            np.minimum(out, x.min(1), out=out)
    return out


def buckets(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number per band, for rows of signatures."""
    own = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    x = np.broadcast_to(SALT, own.shape[:2])
    for i in range(ROWS):
        x = mixed(x ^ own[:, :, i])
    return x.view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, hi, lo, n_shingles, bands): the digest of the set, its size and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, own = [], [], []
            for t in strings(b):
                found = shingles(t, words)
                sizes.append(len(found))
                if len(found):
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    own.append(signature(found))
                else:
                    digests.append(None)
            keys = np.frombuffer(b"".join(x or bytes(16) for x in digests), "<i8").reshape(-1, 2)
            none = np.array([x is None for x in digests], bool)
            bands = buckets(np.stack(own)) if own else np.zeros((0, BANDS), np.int64)
            ends = np.concatenate([[0], np.cumsum(~none * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(keys[:, 0], mask=none), pa.array(keys[:, 1], mask=none),
                 pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                ["doc_id", "text_hash", "hi", "lo", "n_shingles", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, text_hash bigint, hi bigint, lo bigint, n_shingles bigint, "
                                  "bands array<bigint>")


def needed(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of values compared: matches below which a pair is dropped.

    With m of n equal, the posterior of the similarity is Beta(m+1, n-m+1);
    its mass above t is the chance that n+1 trials at t give at most m.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def candidates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, same: bool,
               threshold: float, need: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that stay after all comparisons of MinHash values, some rows of ``a`` at a time."""
    for lo in range(0, len(a), 128):
        own, size = a[lo:lo + 128], size_a[lo:lo + 128, None]
        stay = (size >= threshold * size_b - 1e-6) & (size_b >= threshold * size - 1e-6)
        if same:
            stay &= np.arange(lo, lo + len(own))[:, None] < np.arange(len(b))
        equal = np.zeros(stay.shape, np.int16)
        for k in range(STEP):
            equal += own[:, k, None] == b[None, :, k]
        i, j = np.nonzero(stay & (equal >= need[STEP]))
        m = equal[i, j].astype(np.int64)
        for n in sorted(need)[1:]:
            if not len(i):
                break
            m += (own[i, n - STEP:n] == b[j, n - STEP:n]).sum(1)
            ok = m >= need[n]
            i, j, m = i[ok], j[ok], m[ok]
        if len(i):
            yield i + lo, j


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of a[i] and b[j]."""
    if len(i) <= 4 * (len(set(i.tolist())) + len(set(j.tolist()))):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())],
                        np.int64)
    left, at = np.unique(i, return_inverse=True)
    right, to = np.unique(j, return_inverse=True)
    flat_a, flat_b = np.concatenate([a[x] for x in left]), np.concatenate([b[x] for x in right])
    row_a = np.repeat(np.arange(len(left)), [len(a[x]) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(b[x]) for x in right])
    both = np.intersect1d(flat_a, flat_b)
    keep_a, keep_b = np.isin(flat_a, both), np.isin(flat_b, both)
    col_a, col_b = np.searchsorted(both, flat_a[keep_a]), np.searchsorted(both, flat_b[keep_b])
    row_a, row_b = row_a[keep_a], row_b[keep_b]
    out = np.zeros((len(left), len(right)), np.float32)  # counts stay far below 2^24
    for lo in range(0, len(both), 4096):
        ma, mb = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        for m, row, col in ((ma, row_a, col_a), (mb, row_b, col_b)):
            own = (col >= lo) & (col < lo + 4096)
            m[row[own], col[own] - lo] = 1
        out += ma @ mb.T
    return np.rint(out[at, to]).astype(np.int64)


def compare(all_texts: list[str], block: np.ndarray, bi: int, bj: int, words: int, threshold: float
            ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a tile, as places in its list of texts."""
    exact, need = Fraction(str(threshold)), needed(threshold)
    sets = [shingles(t, words) for t in all_texts]
    marks = np.stack([signature(x) for x in sets])
    sizes = np.array([len(x) for x in sets])
    left = np.flatnonzero(block == bi)
    right = left if bi == bj else np.flatnonzero(block == bj)
    a, b = [sets[x] for x in left], [sets[x] for x in right]
    for i, j in candidates(marks[left], marks[right], sizes[left], sizes[right], bi == bj, threshold, need):
        shared = shared_counts(a, b, i, j)
        union = sizes[left[i]] + sizes[right[j]] - shared
        ok = exact.denominator * shared >= exact.numerator * union
        yield left[i[ok]], right[j[ok]]


def tile_links(pdf: pd.DataFrame, bi: int, bj: int, words: int, threshold: float) -> pd.DataFrame:
    """(cls, n_links, root) of a tile's classes that have links in it."""
    pdf = pdf.drop_duplicates("cls").sort_values("cls")
    own, copies = pdf["cls"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
    links, parent = np.zeros(len(own), np.int64), list(range(len(own)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in compare(pdf["text"].tolist(), pdf["block"].to_numpy(), bi, bj, words, threshold):
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = root(x), root(y)
            if x != y:  # sorted by class, so the smaller place is the smaller number
                parent[max(x, y)] = min(x, y)
    has = np.flatnonzero(links)
    return pd.DataFrame({"cls": own[has], "n_links": links[has], "root": own[[root(x) for x in has.tolist()]]})


def place_in_bitmap(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in keys]), F.lit(BITS))


def id_bitmap(ids: DataFrame) -> Broadcast:
    """Hashed ids (all columns) as a bitmap of ``BITS`` bits: of one size whatever the input."""
    at = place_in_bitmap(ids.columns) + 1  # Spark's bitmaps count from 1
    maps = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros((BITS // BITMAP, BITMAP // 8), np.uint8)
    for bucket, own in maps.collect():  # at most BITS / BITMAP rows
        bits[bucket - 1] = np.frombuffer(own, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits.ravel())


def by_bitmap(docs: DataFrame, bitmap: Broadcast, hit: bool, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows whose keys are in the bitmap (all whose keys were put in, and by
    chance a few others), or the rows that are not, those without an id included.

    So texts that a join cannot need are never shuffled.
    """
    place = F.when(F.col("doc_id").isNotNull(), place_in_bitmap(list(keys))).otherwise(-1)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bitmap.value
        for b in batches:
            at = b.column(len(columns)).to_numpy()
            found = (own[at >> 3] >> (at & 7) & 1).astype(bool) & (at >= 0)
            yield b.filter(pa.array(found == hit)).select(columns)

    return map_batches(docs.withColumn("_place_in_bitmap", place), run, docs.schema)


def linked(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id",
           text_col: str = "text", tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, class_id, class_hash, n_links) of every row: ``class_id``
    and ``class_hash`` are the smallest doc_id, text_hash of the connected texts."""
    ship(docs.sparkSession)
    docs = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")) \
        .withColumn("text_hash", F.xxhash64("text"))
    sketch = stored(sketches(docs, words), "jaccard-sketches")
    # the number stands for the digest: one id can have texts of several classes
    classes = stored(
        sketch.where("hi is not null and doc_id is not null").groupBy("hi", "lo").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")).select(
            F.monotonically_increasing_id().alias("cls"), "hi", "lo", "rep.*", "copies", "n_shingles", "bands"),
        "jaccard-classes")

    # candidate components
    placed = classes.select("cls", F.explode("bands").alias("bucket"))
    heads = placed.groupBy("bucket").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = placed.join(heads, "bucket").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))
    near = components(edges)
    member = near.union(near.select("root", "root").distinct()).toDF("cls", "component") \
        .join(classes.select("cls", "doc_id", "text_hash", "copies", "n_shingles"), "cls")
    member = stored(member, "jaccard-members")

    # tiles: block by block of each component
    size = member.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / tile_texts), F.ceil(F.sum("n_shingles") / tile_shingles)).alias("blocks"))
    dealt = member.join(size, "component").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ("doc_id", "text_hash")
    found_docs = by_bitmap(docs, id_bitmap(member.select(*key)), True, key)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(member.count() / TASK_TEXTS))
    tiles = found_docs.join(dealt.hint("merge"), list(key)).select(
        "component", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
        "block", "cls", "copies", F.coalesce("text", F.lit("")).alias("text"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return tile_links(pdf, int(key[1]), int(key[2]), words, threshold)

    # comparing costs far more than its bytes tell, so the number of tasks follows the texts
    tiles = tiles.repartition(n, "component", "bi", "bj")
    found = stored(tiles.groupBy("component", "bi", "bj").applyInPandas(run, "cls bigint, n_links bigint, root bigint"),
                   "jaccard-links")
    roots = components(found.where("root <> cls").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("n_links").alias("n_links"))

    # a component of classes goes by its smallest id
    joined = roots.union(roots.select("root", "root").distinct()).toDF("cls", "root")
    tops = joined.join(classes.select("cls", "doc_id", "text_hash"), "cls").groupBy("root").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("top"))
    tops = joined.join(tops, "root").select("cls", "top")
    result = classes.select("cls", "hi", "lo", F.struct("doc_id", "text_hash").alias("rep"), "copies") \
        .join(links, "cls", "left").join(tops, "cls", "left") \
        .select("hi", "lo", F.coalesce("top", "rep").alias("top"),
                (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    has_id = F.col("doc_id").isNotNull()
    return sketch.select("doc_id", "text_hash", "hi", "lo").join(result, ["hi", "lo"], "left").select(
        "doc_id", "text_hash", F.when(has_id, F.coalesce("top.doc_id", "doc_id")).alias("class_id"),
        F.when(has_id, F.coalesce("top.text_hash", "text_hash")).alias("class_hash"),
        F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text", tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, class_id, n_links) of every row."""
    return linked(docs, words, threshold, id_col, text_col, tile_texts, tile_shingles) \
        .select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows, with all their columns, of the smallest id (and text hash) of
    connected texts, once each; rows without an id all stay, and rows without
    words stay unless they repeat both id and text."""
    key = ("doc_id", "_text_hash")
    found = stored(linked(docs.select("doc_id", "text"), **options), "jaccard-result") \
        .where("doc_id is not null").withColumnRenamed("text_hash", "_text_hash")
    gone = found.where("doc_id <> class_id or _text_hash <> class_hash").select(*key).distinct()
    again = found.where("doc_id = class_id and _text_hash = class_hash").groupBy(*key) \
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    bitmap = id_bitmap(gone)
    stay = by_bitmap(rows, bitmap, False, key).unionByName(
        by_bitmap(rows, bitmap, True, key).join(gone.hint("merge"), list(key), "left_anti").select(rows.columns))
    if not again.isEmpty():
        stay = stay.join(again, list(key), "left_anti").unionByName(
            stay.join(again, list(key), "left_semi").dropDuplicates(list(key)))
    return stay.select(docs.columns)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLES = {"op7_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[j:j + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS j FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)
), reach(x, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.x WHERE reach.root < links.y
), degree AS (
  SELECT x, count(*) AS n_links FROM links GROUP BY x
)
SELECT r.x AS doc_id, min(r.root) AS class_id, coalesce(any_value(g.n_links), 0) AS n_links
FROM reach r LEFT JOIN degree g ON g.x = r.x GROUP BY r.x
"""}
