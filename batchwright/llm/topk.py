"""Exact top-k search by inner product, in tiles.

Queries come in blocks of bounded size, one broadcast at a time.  Every task
multiplies its candidates with the block tile by tile, keeps ``k`` per query
and tile by partial selection, merges those with the best so far, and emits
``k`` per query.  The lists then merge in two steps: first by (query, group of
tasks), then by query.

Components are floor(256 * x) as integers, so that products and sums are exact:
in 32-bit floats while no sum can reach 2^24, in 64-bit ones up to 2^53, and
else in Python integers, where scores beyond 64 bits are held at the limit and
tie there.

Rows whose vector is null, or holds null, NaN or infinite components, take no
part, nor do rows without an id.  A vector is compared only with vectors of
its own length; empty vectors take no part.  Rows that repeat a vec_id: as
candidates each counts; as queries the smallest of those vectors that take part
stands for all.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchwright.llm.common import map_batches, stored, table

BLOCK_QUERIES = 8192
TILE_QUERIES, TILE_ROWS = 1024, 4096
GROUPS = 64
LIMIT = (1 << 63) - 1


def vectors(batch: pa.RecordBatch, id_col: str, vec_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and integer components (float64) of the rows that take part."""
    col = batch.column(vec_col)
    col = col.cast(pa.list_(pa.float64()))
    n = np.diff(col.offsets.to_numpy())
    lengths = np.where(np.asarray(col.is_valid()), n, 0)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    starts = col.offsets.to_numpy()[:-1]
    has_id = np.asarray(batch.column(id_col).is_valid())
    ids = batch.column(id_col).cast(pa.int64()).fill_null(0).to_numpy()
    out = {}
    for d in np.unique(lengths[has_id]).tolist():
        if d:
            rows = np.flatnonzero((lengths == d) & has_id)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(flat[starts[rows][:, None] + np.arange(d)] * 256)
            ok = np.isfinite(x).all(1)
            if ok.any():
                out[d] = ids[rows[ok]], x[ok]
    return out


class Best:
    """The k best (score, id) of each query, larger scores and then smaller ids first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.top = np.abs(x).max(initial=0)
        self.score = np.zeros((len(ids), 0), object if self.top > 2 ** 31 else np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.there = np.zeros((len(ids), 0), bool)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        bound = self.top * np.abs(x).max(initial=0) * x.shape[1]
        for lo in range(0, len(ids), TILE_ROWS):
            own, tile = ids[lo:lo + TILE_ROWS], x[lo:lo + TILE_ROWS]
            parts = [self._select(q, own, tile, bound) for q in range(0, len(self.ids), TILE_QUERIES)]
            self._merge(*(np.concatenate(p) for p in zip(*parts)))

    def _select(self, q: int, own: np.ndarray, tile: np.ndarray, bound: float):
        """The tile's k best for queries from q on; ids ascend within the tile."""
        ask, mine = self.x[q:q + TILE_QUERIES], self.ids[q:q + TILE_QUERIES]
        k = min(self.k, len(own))
        same = mine[:, None] == own[None, :]
        if bound < 2 ** 40:
            kind = np.float32 if bound < 2 ** 24 else np.float64
            score = ask.astype(kind) @ tile.T.astype(kind)
            # one number orders by score and then by place; exact below 2^53
            key = score.astype(np.float64) * TILE_ROWS - np.arange(len(own))
            key[same] = -np.inf
            at = np.argpartition(key, len(own) - k, axis=1)[:, len(own) - k:]
            got = np.take_along_axis(score, at, 1).astype(np.int64)
        else:
            exact = np.array([[int(v) for v in r] for r in ask], object) @ \
                np.array([[int(v) for v in r] for r in tile], object).T
            exact = np.clip(exact, -LIMIT - 1, LIMIT)
            at = np.array([sorted(range(len(own)), key=lambda j: (bool(same[i, j]), -row[j], j))[:k]
                           for i, row in enumerate(exact)])
            got = np.take_along_axis(exact, at, 1)
        return got, own[at], ~np.take_along_axis(same, at, 1)

    def _merge(self, score: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        score = np.concatenate([self.score, score], 1)
        ids = np.concatenate([self.found, ids], 1)
        there = np.concatenate([self.there, there], 1)
        order = np.lexsort((ids, -score, ~there), axis=1)[:, :self.k] if score.dtype != object else np.array(
            [sorted(range(score.shape[1]), key=lambda j: (not there[i, j], -score[i, j], ids[i, j]))[:self.k]
             for i in range(len(score))])
        self.score, self.found, self.there = (np.take_along_axis(a, order, 1) for a in (score, ids, there))


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
           vec_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best rows with another id."""
    spark = candidates.sparkSession
    rows = candidates.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    # as in vectors(): not empty, and all components finite
    takes_part = (F.size(vec_col) > 0) & F.forall(
        vec_col, lambda x: F.abs(x.cast("double") * 256) < F.lit(float("inf")))
    asked = queries.where(F.col(id_col).isNotNull() & takes_part).groupBy(F.col(id_col).alias("vec_id")) \
        .agg(F.min(vec_col).alias("embedding"))
    n = max(1, math.ceil(queries.count() / block_queries))
    lists = None
    for block in range(n):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).toArrow()
        by_length = defaultdict(list)
        for b in own.to_batches():
            for d, found in vectors(b, "vec_id", "embedding").items():
                by_length[d].append(found)
        shared = spark.sparkContext.broadcast(
            {d: tuple(np.concatenate(c) for c in zip(*parts)) for d, parts in by_length.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(*q, k) for d, q in shared.value.items()}
            for b in batches:
                for d, (ids, x) in vectors(b, "vec_id", "embedding").items():
                    if d in best:
                        best[d].add(ids, x)
            group = TaskContext.get().partitionId() % GROUPS
            for t in best.values():
                q, j = np.nonzero(t.there)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.ids[q]), pa.array(np.full(len(q), group, np.int64)),
                     pa.array(t.found[q, j]), pa.array(t.score[q, j].astype(np.int64))],
                    ["query_id", "task_group", "vec_id", "score"])

        got = map_batches(rows, run, "query_id bigint, task_group bigint, vec_id bigint, score bigint", 4 * TILE_ROWS)
        best = [F.desc("score"), F.asc("vec_id")]
        step = got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "task_group").orderBy(*best)))
        last = step.where(F.col("rank") <= k).withColumn(
            "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
        part = last.select("query_id", "rank", "vec_id", "score")
        if n > 1:  # one block at a time, so that one broadcast is in use
            part = stored(part, "topk")
        lists = part if lists is None else lists.unionByName(part)
    return lists


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLES = {"op9_exact_topk": """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""}
