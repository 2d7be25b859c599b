"""Toxic spans by a linear-chain conditional random field.

Labels are for whole documents, so tokens are labelled first: *cues*, words
and word beginnings that are far likelier in toxic than in other training
texts, are counted over the training texts; a token of a toxic text with a
cue is labelled toxic, all other tokens are not.  The field has two states,
the cues as features, and transitions; its weights are fitted to those labels
by gradient steps on windows around cues and at the beginnings of texts.  A text
with more than ``PLACES`` words with cues gives the windows of that many of
them, taken by a hash of their places, so from all of its length.

Scoring runs forward-backward over whole texts.  Tokens without a cue share
one transfer matrix, so a gap of k of them is that matrix to the k-th power:
the chain's cost is that of its cues, and marginals stay exact.  The expected
number of toxic tokens and the largest marginal give the document's score,
through a logistic function fitted to the training labels.  Tokens whose
marginal reaches ``span_at`` are the offending spans, as code-point offsets:
words with cues, and words between two of those that are at most ``BETWEEN``
apart, whose marginals are computed as well.  The expectation counts words with
cues.

Training takes about ``BOUND`` labelled texts (all, where there are fewer),
chosen by a hash of the id; exact copies count once, and an id with several
labels has the largest.

Null and empty texts have no cue, and score as a text without any.  With no
toxic training text every score is 0.  Every input row gives one output row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import id_fold, labelled_sample, map_batches, stored, strings, table, texts

BOUND = 12_000          # labelled training texts, about
MAX_CUES = 4096         # size of the model
PLACES = 8              # windows around cues of one training text, at most
BETWEEN = 8             # words from one offending cue to the next that a span may cover
MIN_TOXIC = 4           # toxic training texts that hold a cue, at least
MIN_ODDS = 8.0          # how much likelier a cue is in toxic texts, at least
BEGINNINGS = (4, 5, 6)  # letters of word beginnings
REACH = 4               # tokens around a cue in a training window
MEMO = 1 << 17
POWERS = 64
SPAN_AT = 0.5

#: A word as in offsets; the same words after lowering.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = {c: " " for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]}
GAP_BYTES = bytes(32 if b in GAP else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(GAP_BYTES).split()


def cue_names(word: bytes) -> list[str]:
    w = word.decode("utf-8", "surrogatepass")
    return [w] + [f"{w[:n]}*" for n in BEGINNINGS if len(w) > n]


@dataclass
class Field:
    """States: 0 clean, 1 toxic."""

    cues: dict[str, float] = field(default_factory=dict)  # weight of a cue for state 1
    bias: float = 0.0                                     # weight of any token for state 1
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: tuple[float, float, float] | None = None       # constant, of the expectation, of the maximum


class Scorer:
    """A field with what a worker derives from it."""

    def __init__(self, f: Field):
        self.f = f
        self.memo: dict[bytes, float | None] = {}
        background = np.exp(f.moves) * np.exp([0.0, f.bias])[None, :]
        m = background / background.max()
        self.powers = [np.eye(2)]
        for _ in range(POWERS):
            p = self.powers[-1] @ m
            self.powers.append(p / p.max())
        self.far: dict[int, np.ndarray] = {}
        self.m = m
        self.move = np.exp(f.moves).tolist()
        self.start = np.exp(f.start).tolist()
        self.e0 = math.exp(f.bias)

    def evidence(self, word: bytes) -> float | None:
        """Summed weights of a word's cues; None without any."""
        found = [w for c in cue_names(word) if (w := self.f.cues.get(c)) is not None]
        out = sum(found) if found else None
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = out
        return out

    def active(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        """Places and evidence of the words with cues."""
        memo, miss = self.memo, self.evidence
        at, found = [], []
        for i, w in enumerate(words):
            try:
                e = memo[w]
            except KeyError:
                e = miss(w)
            if e is not None:
                at.append(i)
                found.append(e)
        return at, found

    def gap(self, k: int) -> np.ndarray:
        """The transfer matrix of k tokens without cues, up to a factor."""
        if k <= POWERS:
            return self.powers[k]
        if (out := self.far.get(k)) is None:
            out, base, n = np.eye(2), self.m, k
            while n:
                if n & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base /= base.max()
                n >>= 1
            if len(self.far) < 1 << 14:
                self.far[k] = out
        return out

    def marginals(self, n: int, at: list[int], evidence: list[float]) -> list[float]:
        """Chance of the toxic state for the tokens at the given places, of n."""
        emit = [math.exp(min(60.0, self.f.bias + e)) for e in evidence]
        move = self.move
        a, before = None, -1
        forward = []
        for i, e in zip(at, emit):
            k = i - before - 1
            if a is None:
                if k:
                    first = np.array([self.start[0], self.start[1] * self.e0])
                    a = (first @ self.gap(k - 1)).tolist()
                    a = [a[0] * move[0][0] + a[1] * move[1][0], a[0] * move[0][1] + a[1] * move[1][1]]
                else:
                    a = list(self.start)
            else:
                if k:
                    a = (np.array(a) @ self.gap(k)).tolist()
                a = [a[0] * move[0][0] + a[1] * move[1][0], a[0] * move[0][1] + a[1] * move[1][1]]
            a[1] *= e
            total = a[0] + a[1]
            a = [a[0] / total, a[1] / total]
            forward.append(a)
            before = i
        out = []
        b, after = [1.0, 1.0], n
        last = None
        for i, e, a in zip(reversed(at), reversed(emit), reversed(forward)):
            k = after - i - 1
            if last is not None:  # through the next cue's emission and its move
                c0, c1 = b[0], b[1] * last
                b = [move[0][0] * c0 + move[0][1] * c1, move[1][0] * c0 + move[1][1] * c1]
            if k:
                b = (self.gap(k) @ np.array(b)).tolist()
            total = b[0] + b[1]
            b = [b[0] / total, b[1] / total]
            p0, p1 = a[0] * b[0], a[1] * b[1]
            out.append(p1 / (p0 + p1))
            after, last = i, e
        return out[::-1]

    def read(self, text: str) -> tuple[float, float, list[tuple[int, float]]]:
        """Expected toxic tokens among the cues, the largest marginal, and each cue's place and marginal."""
        words = words_of(text)
        at, evidence = self.active(words)
        if not at:
            return 0.0, 0.0, []
        p = self.marginals(len(words), at, evidence)
        return sum(p), max(p), list(zip(at, p))

    def covered(self, text: str, cues: list[tuple[int, float]], span_at: float) -> list[tuple[int, float]]:
        """Places and marginals of the offending words with cues and of the words between near ones."""
        hot = [(i, p) for i, p in cues if p >= span_at]
        extra = [j for (a, _), (b, _) in zip(hot, hot[1:]) if b - a <= BETWEEN for j in range(a + 1, b)]
        if not extra:
            return hot
        words = words_of(text)
        at, evidence = self.active(words)
        both = dict.fromkeys(extra, 0.0) | dict(zip(at, evidence))
        places = sorted(both)
        return [(i, p) for i, p in zip(places, self.marginals(len(words), places, [both[i] for i in places])) if p >= span_at]

    def score(self, expected: float, top: float) -> float:
        if self.f.score is None:
            return 0.0
        c, a, b = self.f.score
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, c + a * math.log1p(expected) + b * top))))


def find_cues(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(cue, toxic texts, other texts) with the best cues first."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[Counter] = [Counter(), Counter()]
            for t, label in zip(strings(b), b.column("label").to_pylist()):
                counts[label == 1].update({c for w in set(words_of(t)) for c in cue_names(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()),
                                              pa.array([counts[1][c] for c in names], pa.int64()),
                                              pa.array([counts[0][c] for c in names], pa.int64())],
                                             ["cue", "toxic", "other"])

    odds = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
    got = map_batches(sample.select("label", "text"), run, "cue string, toxic bigint, other bigint") \
        .groupBy("cue").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")) \
        .where((F.col("toxic") >= MIN_TOXIC) & (odds >= MIN_ODDS)) \
        .orderBy((F.log(odds) * F.sqrt("toxic")).desc(), "cue").limit(MAX_CUES)
    return [tuple(r) for r in got.collect()]


def windows(sample: DataFrame, cues: list[str]) -> list[tuple[list[int], list[list[int]]]]:
    """Training windows: labels, and each token's cue numbers.  One task's
    output is bounded by the sample's bound and the windows taken of a text."""
    shared = sample.sparkSession.sparkContext.broadcast({c: i for i, c in enumerate(cues)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            out = []
            for t, label in zip(strings(b), b.column("label").to_pylist()):
                words = words_of(t)
                own = [[number[c] for c in cue_names(w) if c in number] for w in words]
                hits = [i for i, x in enumerate(own) if x]
                taken = [0, *sorted(sorted(hits, key=lambda i: xxhash.xxh32_intdigest(i.to_bytes(8, "little")))[:PLACES])]
                for i in taken if words else ():
                    lo, hi = max(0, i - REACH), min(len(words), i + REACH + 1)
                    out.append(([int(label == 1 and bool(x)) for x in own[lo:hi]], own[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.list_(pa.int8())),
                                              pa.array([x for _, x in out], pa.list_(pa.list_(pa.int32())))],
                                             ["labels", "cues"])

    got = map_batches(sample.select("label", "text"), run, "labels array<tinyint>, cues array<array<int>>")
    return sorted((list(r[0]), [list(x) for x in r[1]]) for r in got.collect())


def train(rows: list[tuple[list[int], list[list[int]]]], cues: list[str], steps: int = 150, rate: float = 0.3,
          l2: float = 1e-3) -> Field:
    """Weights by Adam steps on the mean log-likelihood of the windows."""
    kinds = Counter((tuple(y), tuple(map(tuple, x))) for y, x in rows)  # equal windows count together
    count = np.array(list(kinds.values()), float)
    share = count / count.sum()
    longest = max((len(y) for y, _ in kinds), default=0)
    y = np.zeros((len(kinds), longest), np.int64)
    there = np.zeros((len(kinds), longest))
    row, col, cue = [], [], []
    for i, (labels, own) in enumerate(kinds):
        y[i, :len(labels)] = labels
        there[i, :len(labels)] = 1
        for j, numbers in enumerate(own):
            for c in numbers:
                row.append(i)
                col.append(j)
                cue.append(c)
    row, col, cue = (np.array(x, np.int64) for x in (row, col, cue))
    k = len(cues)
    w = np.zeros(k + 7)  # cues, bias, start, moves
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        e = np.full(y.shape, w[k])
        np.add.at(e, (row, col), w[cue])
        start, moves = w[k + 1:k + 3], w[k + 3:].reshape(2, 2)
        emit = np.exp(np.stack([np.zeros_like(e), e], -1).clip(-30, 30))
        mv = np.exp(moves)
        f, b = np.zeros(emit.shape), np.ones(emit.shape)
        f[:, 0] = np.exp(start) * emit[:, 0]
        f[:, 0] /= f[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            f[:, t] = (f[:, t - 1] @ mv) * emit[:, t]
            f[:, t] /= f[:, t].sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            nxt = (emit[:, t + 1] * b[:, t + 1]) @ mv.T
            b[:, t] = np.where(there[:, t + 1:t + 2] > 0, nxt / nxt.sum(1, keepdims=True), 1.0)
        p = f * b
        p /= p.sum(2, keepdims=True)
        off = (p[..., 1] - y) * there * share[:, None]
        g = np.zeros_like(w)
        np.add.at(g, cue, off[row, col])
        g[k] = off.sum()
        g[k + 1:k + 3] = ((p[:, 0] - np.eye(2)[y[:, 0]]) * share[:, None]).sum(0)
        for t in range(1, longest):
            pair = f[:, t - 1, :, None] * mv * (emit[:, t] * b[:, t])[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            seen = np.eye(2)[y[:, t - 1]][:, :, None] * np.eye(2)[y[:, t]][:, None, :]
            g[k + 3:] += ((pair - seen) * (there[:, t] * share)[:, None, None]).sum(0).ravel()
        g += l2 * w * np.concatenate([np.full(k, 1.0 / max(1, k)), np.full(7, 0.01)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(dict(zip(cues, w[:k].tolist())), float(w[k]), w[k + 1:k + 3].copy(), w[k + 3:].reshape(2, 2).copy())


def calibrate(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Logistic weights for (1, log(1 + expected), maximum), by Newton steps."""
    x = np.array([[1.0, math.log1p(e), t] for e, t, _ in rows])
    y = np.array([label for _, _, label in rows], float)
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.01, 0.1, 0.1])
        w -= np.linalg.solve(h, x.T @ (p - y) + np.array([0.01, 0.1, 0.1]) * w)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND) -> Field:
    """A field from the labelled rows given; both tables are keyed by doc_id."""
    sample = labelled_sample(docs, labels, label, bound, 1).dropDuplicates(["text", "label"])
    sample = stored(sample.select("label", "text"), "toxicity-sample")
    names = [c for c, _, _ in find_cues(sample)]
    if not names:
        return Field()
    f = train(windows(sample, names), names)
    shared = sample.sparkSession.sparkContext.broadcast(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            got = [s.read(t)[:2] for t in strings(b)]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in got], pa.float64()),
                                              pa.array([t for _, t in got], pa.float64()),
                                              b.column("label").cast(pa.int32())], ["expected", "top", "label"])

    rows = map_batches(sample, run, "expected double, top double, label int").collect()
    f.score = calibrate(sorted((r[0], r[1], r[2]) for r in rows))
    return f


def spans_of(text: str, cues: list[tuple[int, float]], span_at: float) -> list[dict]:
    hot = {i: p for i, p in cues if p >= span_at}
    if not hot:
        return []
    return [{"start": m.start(), "end": m.end(), "p": hot[i]} for i, m in enumerate(WORD.finditer(text)) if i in hot]


def score(df: DataFrame, model: Field, span_at: float = SPAN_AT, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) for every row; spans: start, end, p of each offending word."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            scores, spans = [], []
            for t in strings(b):
                expected, top, cues = s.read(t)
                scores.append(s.score(expected, top))
                spans.append(spans_of(t, s.covered(t, cues, span_at), span_at))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                                             ["doc_id", "score", "spans"])

    src = texts(df, id_col, text_col)
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, "
                                 "spans array<struct<start:bigint,end:bigint,p:double>>")


def keep_clean(df: DataFrame, model: Field, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the limit."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([s.score(*s.read(t)[:2]) < limit for t in strings(b, text_col)], pa.bool_()))

    return map_batches(df, run, df.schema)


def learn_rows() -> Column:
    return id_fold("doc_id", 5) != 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(learn_rows()))
    return score(docs, model).select(
        "doc_id", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.expr("array_join(transform(spans, x -> concat_ws(':', x.start, x.end)), ',')").alias("spans"))
