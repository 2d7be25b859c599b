"""Quality classifier: hashed word n-grams, logistic regression by FTRL.

A text is a sequence of words and runs of symbols.  Features, hashed to
``DIM`` places: each token, each pair of neighbours, each three neighbouring
token classes (lower, capital, upper case, number, or the symbols themselves),
and whether a token repeats the one before.  A feature's value is its share of
the text's features of that sort.

The weights come from follow-the-regularised-leader updates, one labelled text
at a time in the order of a hash of the id, over about ``BOUND`` labelled
texts (all, if there are fewer).  A score is the logistic function of a sparse
dot product.

Null and empty texts have the bias alone.  Without labelled texts every score
is 0.5.  Every input row gives one output row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import id_fold, kept, labelled_sample, map_batches, strings, table, texts

DIM = 1 << 18
BOUND = 6000
EPOCHS = 3
MEMO = 1 << 18
SORTS = 4  # of features
SCALE = 8.0

TOKEN = re.compile(r"\w+|[^\w\s]+")
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def token_class(token: str) -> int:
    """Fixed classes for kinds of words; a run of symbols goes by a hash of its first four."""
    if not (token[0].isalnum() or token[0] == "_"):
        return 16 + xxhash.xxh32_intdigest(token[:4].encode("utf-8", "surrogatepass")) % 1000
    if token.isdigit():
        return 1
    if token.isupper() and len(token) > 1:
        return 2
    return 3 if token[0].isupper() else 4


class Tokens(dict):
    """Token to its hash and class in one number; started anew when full."""

    def __missing__(self, token: str) -> int:
        word = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass"))
        out = (word & ((1 << 50) - 1)) << 12 | token_class(token)
        if len(self) >= MEMO:
            self.clear()
        self[token] = out
        return out


def slots(x: np.ndarray, sort: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(sort * 0x51ED27)) * A
        x ^= x >> np.uint64(29)
        return ((x * B) >> np.uint64(64 - 18)).astype(np.int64)


def features(text: str) -> list[np.ndarray]:
    """Places of the features, by sort, with repetitions."""
    x = np.array(list(map(kept("quality", Tokens).__getitem__, TOKEN.findall(text))), np.uint64)
    if not len(x):
        return []
    word, kind = x >> np.uint64(12), x & np.uint64(4095)
    with np.errstate(over="ignore"):
        pair = word[:-1] * B ^ word[1:]
        three = (kind[:-2] * np.uint64(4099) + kind[1:-1]) * np.uint64(4099) + kind[2:]
    again = (word[1:] == word[:-1]).astype(np.uint64)
    return [slots(f, i) for i, f in enumerate((word, pair, three, again))]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values."""
    parts = [f for f in features(text) if len(f)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    value = np.concatenate([np.full(len(f), SCALE / len(f)) for f in parts])
    at, where = np.unique(np.concatenate(parts), return_inverse=True)
    return at, np.bincount(where, value, len(at))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, epochs: int = EPOCHS, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """Weights after per-coordinate FTRL-proximal updates; the bias is not regularised."""
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    for _ in range(epochs):
        for at, value, label in rows:
            at, value = np.append(at, dim), np.append(value, 1.0)
            w = solve(z[at], n[at], alpha, beta, l1, l2)
            w[-1] = -z[dim] * alpha / (beta + math.sqrt(n[dim]))
            g = (logistic(float(w @ value)) - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return Model(solve(z[:dim], n[:dim], alpha, beta, l1, l2), float(-z[dim] * alpha / (beta + math.sqrt(n[dim]))))


def solve(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0
    return w


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND) -> Model:
    """Trained on the labelled rows given; both tables are keyed by doc_id."""
    sample = labelled_sample(docs, labels, label, bound, 8).repartition("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sparse(t) for t in strings(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.string()), b.column("label"),
                 pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], ["doc_id", "label", "at", "value"])

    got = map_batches(sample, run, "doc_id string, label int, at binary, value binary").collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(r[0]), r[2]))
    return ftrl([(np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4").astype(float), r[1])
                 for r in got])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; the score is the chance of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [logistic(m.bias + sum(SCALE * float(m.weights[f].mean()) for f in features(t) if len(f)))
                   for t in strings(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    src = texts(df, id_col, text_col)
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(id_fold("doc_id", 4) != 2))
    return score(docs, model).select(
        "doc_id", F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
