"""Secret scan: keyword automaton, anchored expressions near hits, checksums.

1. An Aho-Corasick automaton over the keywords runs once over the lower-cased
   text.  A text without a hit costs nothing more.
2. At each hit, and only there, the kind's regular expression is matched
   *anchored* at the hit.  Runs of hex digits have no keyword; they are found
   by one byte translation and a search for the shortest run that counts.
3. Token formats that embed a checksum are accepted only if it is right.

Spans are code-point offsets, end exclusive.  Null text counts as empty and
has no spans; every input row gives one output row, repeated rows included.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import map_batches, strings, table, texts

# The kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_MARK = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
HEX_RUN = b"\x01" * MIN_HEX
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        words.add_word(w, ("assign", len(w)))
    words.add_word("akia", ("access", 4))
    for w in CHECKED:
        words.add_word(w, ("checked", len(w)))
    words.make_automaton()
    return words


def checksum_ok(body: str) -> bool:
    """Whether the last six characters are the CRC-32 of the others in base 62."""
    n, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits == body[-6:]


def find(text: str, words) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every secret of a text, sorted."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered, which would shift the offsets
        low = text.translate(ASCII_LOWER)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in words.iter(low):
        starts.setdefault(kind, []).append(end - n + 1)
    spans = []
    done = 0
    for s in sorted(starts.get("assign", ())):
        if s >= done and (m := ASSIGN.match(text, s)):
            done = m.end()
            if len(m[2]) >= MIN_ASSIGN:
                spans.append((s, 0, m.end()))
    done = 0
    for s in starts.get("access", ()):
        if s >= done and (m := ACCESS.match(text, s)):
            done = m.end()
            if m.end() - s >= MIN_ACCESS:
                spans.append((s, 1, m.end()))
    for s in starts.get("checked", ()):
        if (kind := CHECKED.get(text[s:s + 4])) and (m := BODY.match(text, s + 4)) and checksum_ok(m[0]) \
                and not (s and text[s - 1].isascii() and text[s - 1].isalnum()):
            spans.append((s, KINDS.index(kind), m.end()))
    if HEX_RUN in text.encode("utf-8", "surrogatepass").translate(HEX_MARK):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def span_array(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [x for spans in found for x in spans]
    offsets = [0]
    for spans in found:
        offsets.append(offsets[-1] + len(spans))
    values = pa.StructArray.from_arrays(
        [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()),
         pa.array([e for _, _, e in flat], pa.int64())], names=["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; spans: kind, start, end in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for b in batches:
            found = [find(t, words) for t in strings(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), span_array(found)], ["doc_id", "spans"])

    src = texts(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return map_batches(src, run, f"doc_id {kind}, spans {SPANS}")


def mask(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, each secret in the text replaced by the mark.
    Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = [t if not t or not (spans := find(t, words)) else mask(t, spans, mark)
                   for t in b.column(at).to_pylist()]
            yield b.set_column(at, text_col, pa.array(out, b.schema.field(at).type))

    return map_batches(df, run, df.schema)


def listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counted = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    base = "filter(spans, x -> x.kind in ('assign', 'access', 'hex'))"
    return found.select("doc_id", *counted, F.sha2(listed(base), 256).alias("base_sha256"),
                        listed("spans").alias("spans"))
