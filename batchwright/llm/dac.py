"""Token ids as directly addressable codes, in files that allow random access.

An id is cut into 8-bit chunks, lowest first.  Level 0 holds the first chunk of
every id of the file, level 1 the second chunk of those ids that have one, and
so on.  Every level but the last has a continuation bitmap (bit i: chunk i goes
on in the next level) and a rank directory (ones before each 512-bit block).
Id i is found by its chunk, its bit, and the rank, which is its place one
level down: no neighbour is decoded.  A slice of ids is a slice of every level.

File (little-endian, each section padded to 8 bytes): ``DAC1`` and the number
of levels as 32-bit integers; documents, null document ids, ids as 64-bit
integers; document ids; local starts (one more than documents); then per level
its count, the chunks, the bitmap in whole blocks, and the directory.

Documents are range-partitioned and sorted by id, null ids first; a task writes
its documents to one or more files in that order.  Files get unique names, and
the manifest, written last, lists those of the attempts that succeeded; so a
lost executor costs repeated work and perhaps a file that nobody reads.

Ids are integers.  Null text counts as empty.  Rows that repeat a document id
are all kept, next to each other, in the order of a hash of the text.  An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchwright.llm.common import kept, map_batches, stored, strings, table, texts
from batchwright.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAX_IDS = 1 << 24   # ids after which a task starts another file
SLICE = 1 << 20     # ids that a reader holds at once, unless one document has more
BLOCK = 512
MEMO = 160 << 20    # bytes that a worker uses to remember the ids of stretches, about
MEMO_BYTES = 64     # of a stretch that is remembered
ENTRY = 180         # bytes of an entry besides its stretch and ids, about
MARK = "\x01"       # stands between stretches that are encoded together
WORD = re.compile(rb"[a-z]+").fullmatch
MAGIC = b"DAC1"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def pack(ids: np.ndarray) -> list[bytes]:
    """The level sections of a file."""
    levels = []
    while True:
        levels.append((ids & 255).astype(np.uint8))
        more = ids >> 8 > 0
        levels.append(more)
        ids = ids[more] >> 8
        if not len(ids):
            break
    out = []
    for chunks, more in zip(levels[::2], levels[1::2]):
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
        out.append(struct.pack("<q", len(chunks)) + padded(chunks.tobytes()) + bits.tobytes() + ranks.tobytes())
    return out


def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    nulls = sum(x is None for x in doc_ids)
    levels = pack(ids.astype(np.uint32))
    starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    return b"".join([MAGIC, struct.pack("<iqqq", len(levels), len(doc_ids), nulls, len(ids)), bytes(4),
                     np.array([x or 0 for x in doc_ids], "<i8").tobytes(), starts.astype("<i8").tobytes(), *levels])


HEAD = 4 + 4 + 24 + 4


class Reader:
    """Random access to one file through any seekable handle."""

    def __init__(self, handle):
        self.f = handle
        head = self._at(0, HEAD)
        if head[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        levels, self.docs, self.nulls, self.n = struct.unpack("<iqqq", head[4:32])
        at = HEAD
        self.ids_at, self.starts_at = at, at + 8 * self.docs
        at = self.starts_at + 8 * (self.docs + 1)
        self.levels = []  # count, places of chunks, bits, ranks
        for _ in range(levels):
            n, = struct.unpack("<q", self._at(at, 8))
            chunks = at + 8
            bits = chunks + n + -n % 8
            blocks = -(-n // BLOCK)
            ranks = bits + blocks * (BLOCK // 8)
            self.levels.append((n, chunks, bits, ranks))
            at = ranks + 8 * (blocks + 1)

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids = np.frombuffer(self._at(self.ids_at, 8 * self.docs), "<i8").tolist()
        return [None] * self.nulls + ids[self.nulls:], \
            np.frombuffer(self._at(self.starts_at, 8 * (self.docs + 1)), "<i8")

    def _rank(self, level: int, i: int) -> int:
        _, _, bits, ranks = self.levels[level]
        block, rest = divmod(i, BLOCK)
        n, = struct.unpack("<q", self._at(ranks + 8 * block, 8))
        if rest:
            part = int.from_bytes(self._at(bits + block * (BLOCK // 8), -(-rest // 8)), "little")
            n += (part & ((1 << rest) - 1)).bit_count()
        return n

    def get(self, i: int) -> int:
        """Id i, by one chunk, bit and rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= self._at(chunks + i, 1)[0] << 8 * level
            if not self._at(bits + i // 8, 1)[0] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b (exclusive)."""
        if a >= b:
            return np.zeros(0, np.uint32)
        _, chunks, bits, _ = self.levels[level]
        out = np.frombuffer(self._at(chunks + a, b - a), np.uint8).astype(np.uint32)
        raw = np.frombuffer(self._at(bits + a // 8, -(-b // 8) - a // 8), np.uint8)
        more = np.unpackbits(raw, bitorder="little")[a % 8:a % 8 + b - a].view(bool)
        if more.any():
            first = self._rank(level, a)
            out[more] |= self.slice(first, first + int(more.sum()), level + 1) << 8
        return out


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Memo(dict):
    """Stretch of a text without space or line feed, its ASCII letters lowered
    (unless it spells an added token in some case), to its ids as bytes; started
    anew when full."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        # the library looks for these in the text as it stands, before it lowers letters
        self.room = MEMO
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

        self.word = self.tokenizer.model.tokenize
        self.by_model = not any(map(WORD, self.added))
        # a text that becomes one id and nothing else does, if this vocabulary has it
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def keep(self, part: bytes, out: bytes) -> None:
        if len(part) <= MEMO_BYTES:
            self.room -= ENTRY + len(part) + len(out)
            if self.room < 0:
                self.clear()
                self.room = MEMO
            self[part] = out

    def __missing__(self, part: bytes) -> bytes:
        # the library parts a letter from a full stop or comma too, so the word is shared
        if part[-1:] in (b".", b",") and part[-2:-1].isalpha():
            out = self[part[:-1]] + self[part[-1:]]
        elif self.by_model and WORD(part):
            out = array("I", [x.id for x in self.word(part.decode())]).tobytes()
        else:
            out = self.encode(part.decode()) if part else b""
        self.keep(part, out)
        return out

    def learn(self, parts: list[bytes]) -> None:
        """Encodes the stretches that are no plain words with one call of the
        library; they hold neither ``MARK`` nor added tokens."""
        words = {p[:-1] if p[-1:] in (b".", b",") and p[-2:-1].isalpha() else p for p in parts}
        new = [p for p in words if p and len(p) <= MEMO_BYTES and not WORD(p) and p not in self]
        if len(new) < 2:
            return
        ids = np.array(self.tokenizer.encode(f" {MARK} ".join(p.decode() for p in new), add_special_tokens=False).ids, "<u4")
        cuts = (4 * np.flatnonzero(ids == self.mark)).tolist()
        data = ids.tobytes()
        for p, x, y in zip(new, [0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True):
            self.keep(p, data[x:y])


def id_bytes(name: str, vocabulary: str, text: str, by_spaces: bool) -> bytes:
    """Ids of a text as little-endian 32-bit integers.

    An added token's string in a text is that token, as the library has it.

    ``by_spaces``: for vocabularies of lower-case words whose tokens never cross
    a space or line feed, and that drop both, and to which letters a to z in a row
    are one word; each stretch between spaces is then encoded once, such a word by
    the library's model alone.  Else the whole text goes to the library.
    """
    memo = kept(name, lambda: Memo(vocabulary))
    if not by_spaces:
        return memo.encode(text)
    raw = text.encode().replace(b"\n", b" ")
    low = raw.lower()
    parts = low.split(b" ")
    if any(x in low for x in memo.added):
        parts = [r if any(x in p for x in memo.added) else p for r, p in zip(raw.split(b" "), parts)]
    elif memo.mark is not None and MARK.encode() not in low:
        new = [p for p in parts if p not in memo]
        if len(new) > 1:
            memo.learn(new)
    return b"".join(map(memo.__getitem__, parts))


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, by_spaces: bool = False,
          max_ids: int = MAX_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; the manifest: (part, seq, path, n_docs, n_ids, base)."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    name = f"{spark.sparkContext.applicationId}:{vocabulary}"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, coded = [], [], bytearray()

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, counts, coded
            path = f"{root}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(path) as out:
                out.write(file_bytes(ids, counts, np.frombuffer(bytes(coded), "<u4")))
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "path": [path],
                 "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([len(coded) // 4], pa.int64())})
            seq, ids, counts, coded = seq + 1, [], [], bytearray()
            return row

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), strings(b)):
                got = id_bytes(name, shared.value, text, by_spaces) + end
                ids.append(doc_id)
                counts.append(len(got) // 4)
                coded += got
                if len(coded) >= 4 * max_ids:
                    yield flush()
        if ids:
            yield flush()

    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    src = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    # by id and then hash, so that texts that share an id spread over tasks
    src = src.repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text")) \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    files = stored(map_batches(src, run, "part bigint, seq bigint, path string, n_docs bigint, n_ids bigint"),
                   "dac-manifest")
    # one row per file, so one task orders it at any size of the texts
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                with store.open_input_file(path) as f:
                    r = Reader(f)
                    doc_ids, starts = r.documents()
                    at = 0
                    while at < r.docs:
                        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE, "right")) - 1)
                        own = starts[at:to + 1]
                        data = r.slice(int(own[0]), int(own[-1])).astype("<u4").tobytes()
                        cuts = ((own - own[0]) * 4).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids[at:to], pa.int64()), pa.array(own[:-1] + base, pa.int64()),
                             pa.array([data[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())],
                            ["doc_id", "start", "ids"])
                        at = to

    n = max(1, manifest.count())
    return map_batches(manifest.select("path", "base").repartition(min(n, 10_000)), run,
                       "doc_id bigint, start bigint, ids binary")


def op3_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "dac")
    manifest = write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), folder, by_spaces=True)
    return read(manifest, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
