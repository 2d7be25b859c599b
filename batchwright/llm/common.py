"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.session import scratch_path
from batchwright.sources.tables import load

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that the
    functions below import there even where the package is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_batchwright_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="batchwright-code-"), "batchwright.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    sc.addPyFile(out)
    sc._batchwright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: whatever other columns the
    table has, none can clash with what an operator adds."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | T.StructType, rows: int = 1024) -> DataFrame:
    """``fn`` over the partitions, which sees at most ``rows`` rows at once:
    Python objects take several times the room of a batch."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: fn(pieces(batches, rows)), schema)


#: What the Python worker keeps from one task to the next, for one operator.
KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """The worker's cache of that name.  Asking for another operator's cache
    drops it, so a worker that serves many operators holds one cache."""
    if name not in KEPT:
        KEPT.clear()
        KEPT[name] = make()
    return KEPT[name]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once below ``spark.checkpoint.dir`` and read again:
    later steps neither repeat the work nor depend on one executor's disk."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, null as the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def id_fold(id_col: str, n: int) -> Column:
    """Remainder of the CRC-32 of the id written as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def share(cols: list[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` labelled texts, or all if there are fewer: (doc_id, text, label).

    An id is taken when a hash of it falls below bound / count, so the sample is
    the same however the rows are partitioned.  Its ids are at most a little more
    than ``bound``, which makes broadcasting them safe.  An id with several
    labels has the largest.  Rows that repeat id and text count once; ids may
    still stand on many texts, so rows are then taken by a hash of id and text,
    about 2 * ``bound`` of them at most.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()) \
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    n = usable.count()
    ids = usable.where(share(["doc_id"], seed) < F.lit(min(1.0, bound / max(1, n))))
    rows = stored(texts(docs).join(F.broadcast(ids), "doc_id").dropDuplicates(), "labelled")
    return rows.where(share(["doc_id", "text"], seed + 1) < F.lit(min(1.0, 2 * bound / max(1, rows.count()))))
