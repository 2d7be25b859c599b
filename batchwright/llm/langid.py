"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator that its
code point seeds.  A trigram a, b, c is bound into one vector by multiplying
the letters' vectors, a rotated by two places and b by one.  A text's profile
is the bundle (sum) of the vectors of all its trigrams; runs of other
characters count as one blank.  A language's prototype is the sum of its
training texts' profiles at equal length, less the mean of all languages'
prototypes, which all languages share and which tells nothing.  The prediction
is the language whose prototype has the largest cosine with the text's
profile, and the score is that cosine's place among the languages' (softmax).

Training takes about ``bound`` texts of each language (all, where there are
fewer), chosen by a hash of the id.  Sums are of integers, so they don't
depend on the order of partitions.

Null texts, and texts without a letter, are ``und`` with score 0, as are all
texts where nothing was learned.  Every input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import id_fold, map_batches, share, strings, table, texts

DIM = 1024
BOUND = 2048            # training texts for each language, about
MAX_LANGUAGES = 5000    # prototypes are broadcast; more are refused
SHARP = 12.0            # of the softmax over cosines
DOCS, GRAMS = 512, 1 << 15  # texts, and trigram vectors, held at once

#: By code point: the vector, kept by the worker.
LETTERS: dict[tuple[int, int], np.ndarray] = {}
IS_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not IS_LETTER:
        IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return IS_LETTER[0]


def letter(code: int, dim: int) -> np.ndarray:
    got = LETTERS.get((code, dim))
    if got is None:
        if len(LETTERS) >= 1 << 14:
            LETTERS.clear()
        got = LETTERS[code, dim] = np.random.default_rng([7, code]).integers(0, 2, dim, np.int8) * 2 - 1
    return got


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams as numbers, and their counts; none without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, 0).astype(np.int64)
    codes = codes[is_letter | np.concatenate([[True], is_letter[:-1]])]  # one blank for each run
    codes = np.concatenate([[0] * int(codes[0] != 0), codes, [0] * int(codes[-1] != 0)]).astype(np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bound_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    out = None
    for place in range(3):
        codes, at = np.unique(grams >> (42 - 21 * place) & 0x1FFFFF, return_inverse=True)
        own = np.stack([np.roll(letter(c, dim), 2 - place) for c in codes.tolist()])[at]
        out = own if out is None else np.multiply(out, own, out=out)
    return out


def profiles(found: list[tuple[np.ndarray, np.ndarray]], dim: int) -> np.ndarray:
    """One row for each text: the sum of its trigrams' vectors."""
    out = np.zeros((len(found), dim), np.float64)
    grams = np.unique(np.concatenate([g for g, _ in found])) if found else np.zeros(0, np.int64)
    for lo in range(0, len(grams), GRAMS):
        own = grams[lo:lo + GRAMS]
        vectors = bound_vectors(own, dim)
        for row, (g, n) in enumerate(found):
            a, b = np.searchsorted(g, own[0]), np.searchsorted(g, own[-1], "right")
            if a < b:
                part = vectors[np.searchsorted(own, g[a:b])]
                kind = np.float32 if n[a:b].sum() < 1 << 24 else np.float64  # exact either way
                out[row] += n[a:b].astype(kind) @ part.astype(kind)
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def fit(train: DataFrame, dim: int = DIM, bound: int = BOUND) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from (doc_id, text, lang)."""
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # a checked number of rows, so the texts need not move by language
    shares = train.sparkSession.createDataFrame([(r[0], min(1.0, bound / r[1])) for r in counts], "lang string, part double")
    sample = train.join(F.broadcast(shares), "lang").where(share(["doc_id"], 5) < F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, all_texts = b.column("lang").to_pylist(), strings(b)
            for lo in range(0, len(langs), DOCS):
                rows = scaled(profiles([trigrams(t) for t in all_texts[lo:lo + DOCS]], dim))
                for lang, row in zip(langs[lo:lo + DOCS], np.rint(rows * 1e6).astype(np.int64)):
                    sums[lang] = sums[lang] + row if lang in sums else row
            if len(sums) > 256:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    def emit(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim)), pa.array(row)],
                                             ["lang", "dim", "value"])

    parts = map_batches(sample.select("lang", "text"), run, "lang string, dim bigint, value bigint")
    got = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    langs = sorted(got["lang"].unique())
    out = np.zeros((len(langs), dim))
    out[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), got["dim"].to_numpy(int)] = got["value"]
    out = scaled(out)
    return langs, scaled(out - out.mean(0)) if len(langs) > 1 else out


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    langs, prototypes = model
    shared = df.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            all_texts = strings(b)
            preds, scores = [], []
            for lo in range(0, len(all_texts), DOCS):
                found = [trigrams(t) for t in all_texts[lo:lo + DOCS]]
                if not langs:
                    preds += ["und"] * len(found)
                    scores += [0.0] * len(found)
                    continue
                cosines = scaled(profiles(found, own.shape[1])) @ own.T
                top = cosines.argmax(1)
                weight = np.exp(SHARP * (cosines - cosines.max(1, keepdims=True)))
                for (g, _), t, w in zip(found, top.tolist(), weight):
                    preds.append(langs[t] if len(g) else "und")
                    scores.append(float(1 / w.sum()) if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(preds, pa.string()),
                                              pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    src = texts(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return map_batches(src, run, f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where((id_fold("doc_id", 4) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return predict(docs, fit(train)).select(
        "doc_id", F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
