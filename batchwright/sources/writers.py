"""Table and partition writes (A3-A6, A12) on path-based parquet tables.

* ``overwrite_table``: replace the whole table; columns are written in the
  given order (a positional INSERT depends on it).
* ``overwrite_partition``: replace exactly the partitions present in the
  data (dynamic partition overwrite, set on this writer only, never globally);
  a static spec such as {'dt': '20260613', 'hr': '03'} replaces that one
  partition, also by an empty load.
* ``append_rows`` / ``append_partition``: append, optionally into a static
  partition spec.
* ``archive_by_month`` / ``expired`` / ``drop_expired``: month-partitioned
  storage and age-based retention.

Partition values are strings (``dt`` yyyyMMdd, ``hr`` HH, ``m`` yyyyMM); read
back with an explicit schema so they are never re-inferred as numbers.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from batchwright.session import scratch_path


def _clustered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Group rows by partition before a partitioned write so each partition
    gets few files.  ``rebalance`` (not ``repartition``) lets AQE split a
    partition holding a large share of the rows over several tasks and merge
    small ones, instead of sending a hot partition to one task."""
    return df.hint("rebalance", *cols) if cols else df


def _with_spec(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    for k, v in spec.items():
        df = df.withColumn(k, F.lit(v).cast("string"))
    return df


# Characters that Spark writes as %XX in the name of a partition folder.
_ESCAPED = re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def _escaped(value: str) -> str:
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value)


def overwrite_table(df: DataFrame, path: str, columns: Sequence[str] | None = None,
                    partition_cols: Sequence[str] = ()) -> None:
    """A3: replace the whole table with ``df`` (columns in ``columns`` order),
    optionally laid out in partitions."""
    out = df.select(*columns) if columns else df
    w = _clustered(out, list(partition_cols)).write.mode("overwrite")
    if partition_cols:
        w = w.option("partitionOverwriteMode", "static").partitionBy(*partition_cols)
    w.parquet(path)


def overwrite_partition(df: DataFrame, path: str, spec: Mapping[str, str] | None = None,
                        partition_cols: Sequence[str] = ()) -> None:
    """A4: replace only the partitions the data covers.

    A spec that names every partition column replaces exactly that partition,
    with nothing if ``df`` is empty, as ``INSERT OVERWRITE ... PARTITION``
    does.  Dynamic mode replaces what it has rows for, so after an empty load
    the partition's old files are still there, and are then removed."""
    spec = dict(spec or {})
    cols = list(partition_cols) or list(spec)
    exact = bool(spec) and set(spec) == set(cols)
    spark = df.sparkSession
    folder = "/".join([path, *(f"{c}={_escaped(str(spec[c]))}" for c in cols)]) if exact else path
    before = _files(spark, folder) if exact else set()
    out = _clustered(_with_spec(df, spec), cols)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cols).parquet(path))
    if exact and before & _files(spark, folder):
        _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def _files(spark: SparkSession, folder: str) -> set[str]:
    """Names of the files of one partition's folder."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(hpath)} if fs.exists(hpath) else set()


def append_rows(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """A5: append rows (e.g. literal rows from ``createDataFrame``)."""
    w = _clustered(df, list(partition_cols)).write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def append_partition(df: DataFrame, path: str, spec: Mapping[str, str],
                     partition_cols: Sequence[str] | None = None) -> None:
    """Append ``df`` into the static partition ``spec``."""
    cols = list(partition_cols or spec)
    _clustered(_with_spec(df, spec), cols).write.mode("append").partitionBy(*cols).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               partition_cols: Sequence[str] = ()) -> DataFrame:
    """Read a path table with its partition columns as strings.

    Partition type inference is switched off for this read only (Spark
    resolves the file listing and partition values while ``parquet()`` is
    called), so values like ``03`` or ``20260613`` keep their text.  The
    table is listed once.  ``partition_cols`` documents the expected
    partition columns; every partition column comes back as a string."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)
    missing = [c for c in partition_cols if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no partition columns {missing}")
    return df


def month_of(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyyMM")


def archive_by_month(df: DataFrame, ts: str, path: str, col: str = "m") -> None:
    """Write facts partitioned by month of ``ts`` (dynamic overwrite:
    re-archiving a month replaces only that month)."""
    overwrite_partition(df.withColumn(col, month_of(ts)), path, partition_cols=[col])


def _limit(days: int, as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))


def is_expired(ts: str, days: int, as_of: str) -> Column:
    """Older than ``days`` days before ``as_of``."""
    return F.col(ts) < _limit(days, as_of)


def expired(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """Rows older than ``days`` before ``as_of`` (retention candidates)."""
    return df.filter(is_expired(ts, days, as_of))


def drop_expired(spark: SparkSession, path: str, ts: str, days: int, as_of: str, col: str = "m",
                 keep: DataFrame | None = None, keys: Sequence[str] = ()) -> list[str]:
    """Retention that acts on an archive of ``archive_by_month``.

    Expired rows go, but for those whose ``keys`` occur in ``keep`` (what a
    running instance still refers to; a NULL key refers to nothing).  Only the
    months up to the one of the limit are read, of fully expired ones only
    with ``keep``.  A month with rows left is rewritten with these; then the
    others are dropped as folders.  Rows without a time stay.  What stays is
    written below the checkpoint folder first, so a run that dies can be
    repeated.  Returns the dropped months.
    """
    last = spark.range(1).select(month_of(_limit(days, as_of))).first()[0]
    old = read_table(spark, path, partition_cols=[col]).where(F.col(col) <= last)
    stays = old.where((F.col(col) == last) & ~is_expired(ts, days, as_of))
    if keep is not None:
        referred = keep.select(*keys).dropna().distinct()
        stays = stays.unionByName(old.where(is_expired(ts, days, as_of)).join(referred, list(keys), "left_semi").select(*old.columns))
    scratch = scratch_path(spark, "retention")
    stays.write.parquet(scratch)
    stays = spark.read.schema(stays.schema).parquet(scratch)
    left = {r[0] for r in stays.select(col).distinct().collect()}
    if left:
        overwrite_partition(stays, path, partition_cols=[col])
    months = {name[len(col) + 1:] for name in _files(spark, path) if name.startswith(f"{col}=")}
    dropped = sorted(m for m in months - left if m.isdigit() and m <= last)
    for m in dropped:
        _remove(spark, f"{path}/{col}={m}")
    return dropped


def insert_into(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """A3/A5 on a catalog table: ``INSERT [OVERWRITE] INTO table`` semantics,
    columns matched by position (``insertInto``), so the select order is the
    contract.  Rows of a partitioned table are rebalanced on its partition
    columns first, as in the path writers."""
    target = df.sparkSession.catalog.listColumns(table)
    # columns match by position, so the table's partition columns are fed by
    # the select's columns at the same positions
    cols = [df.columns[i] for i, c in enumerate(target) if c.isPartition and i < len(df.columns)]
    _clustered(df, cols).write.insertInto(table, overwrite=overwrite)
