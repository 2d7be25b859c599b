"""Byte-level BPE, encoding and decoding.

A text is split by the vocabulary's pattern; each match is encoded on its own:

1. A minimal perfect hash over the vocabulary (every slot used, no key stored
   twice) resolves a match that is itself a token.
2. Any other match goes through merges: its bytes form a linked list, of which
   the adjacent pair that is first by rank, then place, is merged next.  A heap
   yields it; of short matches many are merged at once, as rows of an array, and
   the smallest rank of each row yields it.

Both results enter memos, kept by the Python worker from one task to the next:
one of matches, and one of stretches between spaces, which spares most texts the
pattern.  What a few texts hold is looked up at once, and what is not known is
encoded together.  Between two such groups the memos take at most about 2.5
times ``MEMO`` bytes together; what is longer than ``MEMO_LETTERS`` stays out.
They save time only.

Ids are little-endian unsigned 32-bit integers in one binary column.  Null
text counts as empty and gives no ids; every input row gives one output row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import kept, map_batches, strings, table, texts

MEMO = 24 << 20
MEMO_LETTERS = 64
ENTRY = 180  # bytes of an entry besides its key and ids, about
PARTS = 1 << 15  # stretches or matches that are looked up at once
ROWS = 128
RANKS = "byte_bpe_50k.tiktoken"

MASK = (1 << 64) - 1
MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
NONE = -1  # for the rank of a pair that is no token
NEVER = 1 << 40  # the same, behind all ranks
GONE, FREE = -1, -2  # for an id that is not there; for a slot without a pair
WIDTHS = 8, 16, 32  # bytes of matches that are merged many at once, in classes
FEW, ROOM = 64, 8192  # matches fewer than this are merged one by one; at most so many at once


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


class PerfectHash:
    """Keys to values by hash and displace: a bucket's displacement sends each
    of its keys to a slot of its own; there are as many slots as keys."""

    def __init__(self, pairs: list[tuple[bytes, int]]):
        n = self.n = len(pairs)
        m = self.m = max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k, _ in pairs], np.uint64)
        order = np.argsort(hashes % np.uint64(m), kind="stable")
        counts = np.bincount((hashes % np.uint64(m)).astype(np.int64), minlength=m)
        ends = np.cumsum(counts)
        self.shift = [0] * m
        slots = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        free = None
        for bucket in np.argsort(-counts, kind="stable"):
            own = order[ends[bucket] - counts[bucket]:ends[bucket]]
            if len(own) > 1:
                d = 0
                while True:
                    tries = np.arange(d, d + 64, dtype=np.uint64)[:, None]
                    at = self.places(hashes[own][None, :], tries, n)
                    ok = ~taken[at].any(1)
                    for row in np.flatnonzero(ok):
                        if len(set(at[row].tolist())) == len(own):
                            self.shift[bucket] = d + int(row)
                            slots[own] = at[row]
                            taken[at[row]] = True
                            break
                    else:
                        d += 64
                        continue
                    break
            elif len(own):  # a lone key takes any free slot, named outright
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                slot = next(free)
                self.shift[bucket] = -slot - 1
                slots[own] = slot
        self.shifts = np.array(self.shift, np.int64)
        # what a hash is displaced by; a slot that is named outright, as it is
        self.shift = [d if d < 0 else d * MIX_A & MASK for d in self.shift]
        self.longest = max((len(k) for k, _ in pairs), default=0)
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for (k, v), s in zip(pairs, slots.tolist()):
            self.keys[s], self.values[s] = k, v

    @staticmethod
    def places(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(MIX_A))) * np.uint64(MIX_B)
        return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    def get(self, key: bytes) -> int | None:
        if len(key) > self.longest:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        slot = -d - 1 if d < 0 else (((h ^ d) * MIX_B & MASK) >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else None

    def get_all(self, keys: list[bytes]) -> list[int | None]:
        """The same for many."""
        if not self.n:
            return [None] * len(keys)
        h = np.array(list(map(xxhash.xxh3_64_intdigest, keys)), np.uint64)
        d = self.shifts[h % np.uint64(self.m)]
        at = np.where(d < 0, -d - 1, self.places(h, d.astype(np.uint64), self.n)).tolist()
        return [self.values[i] if self.keys[i] == k else None for k, i in zip(keys, at)]


class Pairs:
    """Ranks of pairs of ids, looked up for whole arrays: open addressing, a quarter full at most."""

    def __init__(self, ranks: dict[int, int]):
        keys = np.fromiter(ranks.keys(), np.int64, len(ranks))
        bits = (4 * len(ranks) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, FREE, np.int64)
        self.ranks = np.full(1 << bits, NEVER, np.int64)
        at, values = self.first(keys), np.fromiter(ranks.values(), np.int64, len(ranks))
        while len(keys):
            free = self.keys[at] == FREE
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.ranks[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def first(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(MIX_A) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = self.first(keys)
        held = self.keys[at]
        out = self.ranks[at]
        todo = np.flatnonzero((held != keys) & (held != FREE))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            out[todo] = self.ranks[at[todo]]
            todo = todo[(held != keys[todo]) & (held != FREE)]
        return out


class Vocabulary:
    """What the executors need of a rank file; small and of fixed size."""

    def __init__(self, pairs: list[tuple[bytes, int]], pattern: str):
        self.pattern = pattern
        self.whole = PerfectHash(pairs)
        ids = dict(pairs)
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        # rank of the token that two adjacent tokens form together
        self.pair = {ids[t[:i]] << 32 | ids[t[i:]]: r for t, r in pairs for i in range(1, len(t))
                     if t[:i] in ids and t[i:] in ids}
        # the same for two bytes
        self.two = [self.pair.get(a << 32 | b, NONE) for a in self.of_byte for b in self.of_byte]
        self.pairs = Pairs(self.pair)
        self.bytes = np.array(self.of_byte, np.int64)
        self.twos = np.array([NEVER if r == NONE else r for r in self.two], np.int64)
        self.token = [b""] * (max(ids.values()) + 1)
        for t, i in pairs:
            self.token[i] = t
        self.tokens = pa.array(self.token, pa.large_binary())

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a match that is no token itself."""
        pair, two, push, pop = self.pair.get, self.two, heapq.heappush, heapq.heappop
        ids = list(map(self.of_byte.__getitem__, piece))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        bits = n.bit_length()
        place = (1 << bits) - 1
        # of the pair that begins at a place: its rank, or NONE
        rank = [two[a << 8 | b] for a, b in zip(piece, piece[1:])]
        heap = [r << bits | i for i, r in enumerate(rank) if r != NONE]
        rank.append(NONE)
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, r = x & place, x >> bits
            if rank[i] != r:
                continue  # one of the two has been merged since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank[j] = r, -1, NONE
            if k < n:
                before[k] = i
                s = rank[i] = pair(r << 32 | ids[k], NONE)
                if s != NONE:
                    push(heap, s << bits | i)
            else:
                rank[i] = NONE
            h = before[i]
            if h >= 0:
                s = rank[h] = pair(ids[h] << 32 | r, NONE)
                if s != NONE:
                    push(heap, s << bits | h)
        return [x for x in ids if x >= 0]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The same for many matches, as the bytes of their ids."""
        out = [b""] * len(pieces)
        least = 0
        for width in WIDTHS:
            own = [i for i, p in enumerate(pieces) if least < len(p) <= width]
            least = width
            if len(own) < FEW:
                for i in own:
                    out[i] = array("I", self.merge(pieces[i])).tobytes()
                continue
            for j in range(0, len(own), ROOM):
                some = own[j:j + ROOM]
                for i, ids in zip(some, self.merge_rows([pieces[i] for i in some], width)):
                    out[i] = ids
        for i, p in enumerate(pieces):
            if len(p) > least:
                out[i] = array("I", self.merge(p)).tobytes()
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Matches of up to ``width`` bytes, each a row of linked bytes: every round
        merges in each row the pair that is first by rank and then place."""
        n, w = len(pieces), width + 2  # nothing stands before and behind the bytes
        raw = np.frombuffer(b"".join([b"\0" + p.ljust(w - 1, b"\0") for p in pieces]), np.uint8).reshape(n, w)
        size = np.fromiter(map(len, pieces), np.int64, n)[:, None]
        place = np.arange(w)
        ids = np.where((place > 0) & (place <= size), self.bytes[raw], GONE).ravel()
        rank = np.full((n, w), NEVER, np.int64)
        rank[:, :-1] = np.where((place[:-1] > 0) & (place[:-1] < size),
                                self.twos[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], NEVER)
        flat = rank.ravel()
        after, before = np.tile(place + 1, n), np.tile(place - 1, n)
        live = np.arange(n)
        while True:
            i = rank[live].argmin(1)
            r = rank[live, i]
            some = np.flatnonzero(r < NEVER)
            if not len(some):
                break
            live, r = live[some], r[some]
            row = live * w
            at = row + i[some]
            gone = row + after[at]
            right, left = row + after[gone], row + before[at]
            after[at], before[right] = after[gone], i[some]
            ids[at], ids[gone], flat[gone] = r, GONE, NEVER
            flat[at] = self.pairs.get(r, ids[right])
            flat[left] = self.pairs.get(ids[left], r)
        left = ids >= 0
        ends = (4 * np.cumsum(left.reshape(n, w).sum(1))).tolist()
        data = ids[left].astype("<u4").tobytes()
        return [data[i:j] for i, j in zip([0, *ends], ends)]


def runs(items: list, most: int) -> Iterator[list]:
    """Neighbours of ``most`` elements together at most; a longer one is alone."""
    out, n = [], 0
    for x in items:
        if out and n + len(x) > most:
            yield out
            out, n = [], 0
        out.append(x)
        n += len(x)
    if out:
        yield out


class Memo:
    """Key to the bytes of its ids, in two generations: a full one becomes the
    old one, from which keys that occur again return."""

    def __init__(self, room: int):
        self.now: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.long: list[str] = []
        self.size = self.room = room

    def new(self, keys: set[str]) -> list[str]:
        """Those of the keys that are not known."""
        keys = keys.difference(self.now)
        back = [k for k in keys if k in self.old]
        self.add(back, [self.old[k] for k in back])
        return list(keys.difference(back))

    def add(self, keys: list[str], ids: list[bytes | None]) -> None:
        self.now.update(zip(keys, ids))
        self.room -= ENTRY * len(keys) + sum(map(len, keys)) + sum(len(x) for x in ids if x)
        self.long += [k for k in keys if len(k) > MEMO_LETTERS]

    def learn(self, keys: set[str]) -> None:
        raise NotImplementedError

    def of(self, lists: list[list[str]]) -> Iterator[list[bytes | None]]:
        """What each key of each list stands for."""
        for some in runs(lists, PARTS):
            if len(some) > 1:
                self.learn(set(chain.from_iterable(some)))
                found = [list(map(self.now.__getitem__, x)) for x in some]
                self.turn()
                yield from found
            else:
                one: list[bytes | None] = []
                for i in range(0, len(some[0]), PARTS):
                    own = some[0][i:i + PARTS]
                    self.learn(set(own))
                    one += map(self.now.__getitem__, own)
                    self.turn()
                yield one

    def turn(self) -> None:
        """What is long goes, and what is full becomes old."""
        for k in self.long:
            out = self.now.pop(k, None)
            self.room += ENTRY + len(k) + len(out or b"")
        self.long = []
        if self.room < 0:
            self.old, self.now, self.room = self.now, {}, self.size


class Matches(Memo):
    """Matches of the pattern."""

    def __init__(self, vocabulary: Vocabulary, room: int):
        super().__init__(room)
        self.vocabulary = vocabulary

    def ids(self, keys: list[str]) -> list[bytes]:
        pieces = [k.encode() for k in keys]
        whole = self.vocabulary.whole.get_all(pieces)
        merged = iter(self.vocabulary.merge_all([p for p, x in zip(pieces, whole) if x is None]))
        return [next(merged) if x is None else x.to_bytes(4, "little") for x in whole]

    def learn(self, keys: set[str]) -> None:
        new = self.new(keys)
        self.add(new, self.ids(new))


class Stretches(Memo):
    """What follows a space, up to the next space or line feed, as the ids of the
    space and it; or, with the line feed, what follows a line feed.

    Where no white space is next to them, every match that holds this space or
    line feed begins there, so no match crosses the ends of a stretch.  Where
    matches may cross them, the stretch is known as None.
    """

    def __init__(self, matches: Matches, split: Callable[[str], list[str]], room: int):
        super().__init__(room)
        self.matches, self.split = matches, split

    def cut(self, key: str) -> tuple[str, list[str]] | None:
        """The stretch that the first match is with its space, if it has one, and the other matches."""
        if key.isalpha():
            return key, []
        if key[-1:] in MARKS and key[:-1].isalpha():
            return key[:-1], [key[-1]]
        own = key[1:] if key[:1] == "\n" else key
        if not own or own[0].isspace() or own[-1].isspace():
            return None
        if own is not key:
            return "", self.split(key)
        first, *rest = self.split(" " + key)
        return first[1:], rest

    def learn(self, keys: set[str]) -> None:
        cut = {k: self.cut(k) for k in self.new(keys)}
        single = [k for k, x in cut.items() if x and not x[1]]
        several = [(k, *x) for k, x in cut.items() if x and x[1]]
        single += self.new({first for _, first, _ in several if first}.difference(single))
        self.add(single, self.matches.ids([" " + k for k in single]))
        self.matches.learn({m for *_, rest in several for m in rest})
        stretch, match = self.now.__getitem__, self.matches.now.__getitem__
        self.add([k for k, *_ in several],
                 [(stretch(first) if first else b"") + b"".join(map(match, rest)) for _, first, rest in several])
        unclear = [k for k, x in cut.items() if x is None]
        self.add(unclear, [None] * len(unclear))

    def turn(self) -> None:
        super().turn()
        self.matches.turn()


#: Marks that are one match each behind letters and before white space.
MARKS = frozenset(".,;:!?")

#: Spaces without other white space around them.
CLEAR = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import public_tokenizers
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.matches = Matches(vocabulary, MEMO // 4)
        # other patterns may have matches that go on behind a space
        self.by_spaces = vocabulary.pattern == public_tokenizers.PATTERN
        self.stretches = Stretches(self.matches, self.split, MEMO)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.by_spaces:
            return self.plainly(texts)
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        found = self.stretches.of([x[1:] for x in parts])
        out = [None if None in ids or ids and x[0][-1:].isspace() else b"".join(ids) for x, ids in zip(parts, found)]
        clear = [i for i, ids in enumerate(out) if ids is not None]
        for i, ids in zip(clear, self.plainly([parts[i][0] for i in clear])):
            out[i] = ids + out[i]
        unclear = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(unclear, self.between_clear_spaces([texts[i] for i in unclear])):
            out[i] = ids
        return out

    def plainly(self, texts: list[str]) -> list[bytes]:
        return [b"".join(ids) for some in runs(texts, 4 * PARTS) for ids in self.matches.of([self.split(t) for t in some])]

    def between_clear_spaces(self, texts: list[str]) -> list[bytes]:
        parts = [CLEAR.split(t) for t in texts]
        found = list(self.stretches.of([x[1:] for x in parts]))
        todo = [(ids, j, " " + x[j + 1]) for x, ids in zip(parts, found) for j, own in enumerate(ids) if own is None]
        for (ids, j, _), own in zip(todo, self.plainly([t for *_, t in todo])):
            ids[j] = own
        return [head + b"".join(ids) for head, ids in zip(self.plainly([x[0] for x in parts]), found)]


def bytes_of(ids: bytes, token: list[bytes]) -> bytes:
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def all_bytes_of(ids: list[bytes], tokens: pa.Array) -> Iterator[memoryview]:
    """The same for many, with the tokens in one large_binary array."""
    for some in runs(ids, 4 * 8 * PARTS):
        out = tokens.take(pa.array(np.frombuffer(b"".join(some), "<u4")))
        _, offsets, data = out.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.cumsum([0] + [len(x) // 4 for x in some])].tolist()
        view = memoryview(data or b"")
        yield from (view[i:j] for i, j in zip(ends, ends[1:]))


def encoder(shared: Shared) -> Encoder:
    return kept(shared.name, lambda: Encoder(shared.value))


class Shared:
    """A broadcast vocabulary with a name that stays the same between tasks."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.name = f"{spark.sparkContext.applicationId}:{path}:{pattern}"
        self.data = spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))

    @property
    def value(self) -> Vocabulary:
        return self.data.value


def vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Shared:
    import public_tokenizers

    return Shared(spark, path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN)


def encode(df: DataFrame, vocab: Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            ids = pa.array(enc.encode_all(strings(b)), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    src = texts(df, id_col, text_col)
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, vocab: Shared) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocab.value.tokens
        for b in batches:
            out = pa.array([bytes(x) for x in all_bytes_of(b.column("ids").to_pylist(), tokens)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), out], ["doc_id", "ids", "decoded"])

    return map_batches(df.select("doc_id", "ids"), run,
                       f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocab: Shared) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row: encoded
    and decoded by one worker, a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        tokens = enc.vocabulary.tokens
        for b in batches:
            ids = enc.encode_all(strings(b))
            decoded = [hashlib.sha256(x).hexdigest() for x in all_bytes_of(ids, tokens)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                                             ["doc_id", "ids", "decoded_sha256"])

    src = texts(docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    return map_batches(src, run, f"doc_id {kind}, ids binary, decoded_sha256 string", ROWS).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        "decoded_sha256", "ids")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary(spark)).drop("ids")
