"""Immutable versioned datasets with manifest and read-back check.

Layout: ``{root}/{env}/{name}/{version}/`` holds the data; the manifest is a
one-row JSON file in ``{root}/{env}/{name}/{version}/_manifest``.  An
existing version is a conflict and is never overwritten.

The content digest is order independent: row count, the sum of
``xxhash64`` over all columns (as a 38-digit decimal, no overflow) and the
xor of the same hashes.  The digest of the frame sent is observed during the
write (``DataFrame.observe``, no second pass over the source); the digest of
the files read back is a distributed aggregation.  Both are stable under any
repartitioning and move no data to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed path segment pattern.
SEGMENT_PATTERN = r"^[A-Za-z0-9._-]+$"
DOTS_ONLY = r"^\.+$"

MANIFEST_SCHEMA = T.StructType([
    T.StructField("env", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("version_id", T.StringType()),
    T.StructField("draft_revision_id", T.StringType()),
    T.StructField("baked_at", T.StringType()),
    T.StructField("baked_by", T.StringType()),
    T.StructField("project_var_versions", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("n_rows", T.LongType()),
    T.StructField("byte_size", T.LongType()),
    T.StructField("hash_sum", T.StringType()),
    T.StructField("hash_xor", T.LongType()),
    T.StructField("status", T.StringType()),
])


class VersionConflict(RuntimeError):
    pass


class VerificationFailed(RuntimeError):
    pass


def valid_segment(col: str | Column) -> Column:
    """Usable as a path segment: only ``[A-Za-z0-9._-]``, not empty,
    and not made of dots only (``.``, ``..``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(SEGMENT_PATTERN) & ~c.rlike(DOTS_ONLY), F.lit(False))


def _check_segment(value: str, label: str) -> None:
    import re
    if not value or not re.fullmatch(SEGMENT_PATTERN[1:-1], value) or set(value) <= {"."}:
        raise ValueError(f"{label} must match {SEGMENT_PATTERN} and not be dots only, got {value!r}")


def version_path(root: str, env: str, name: str, version: str) -> str:
    for v, label in ((env, "env"), (name, "name"), (version, "version")):
        _check_segment(v, label)
    return f"{root.rstrip('/')}/{env}/{name}/{version}"


def _digest_exprs(df: DataFrame, text_col: str | None = None) -> list[Column]:
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    size = F.sum(F.octet_length(text_col)).cast("long") if text_col else F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(size, F.lit(0).cast("long")).alias("byte_size"),
            F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
             .cast("string").alias("hash_sum"),
            F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("hash_xor")]


def digest(df: DataFrame, text_col: str | None = None) -> DataFrame:
    """One row (n_rows, byte_size, hash_sum, hash_xor); ``byte_size`` is the
    UTF-8 size of ``text_col`` when given."""
    return df.agg(*_digest_exprs(df, text_col))


def content_digest(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Lower-hex sha256 of the UTF-8 text and its byte length, per row."""
    return df.withColumn("sha256", F.sha2(F.col(text_col), 256)) \
             .withColumn("byte_size", F.octet_length(text_col).cast("long"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def _claim(spark: SparkSession, path: str) -> bool:
    """Take a version that does not exist yet; of two writers at once, one gets
    it (the file system creates the claim file only if it is not there)."""
    if _exists(spark, path):
        return False
    jvm = spark.sparkContext._jvm
    claim = jvm.org.apache.hadoop.fs.Path(f"{path}/_claim")
    return claim.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(claim)


def _write_manifest(spark: SparkSession, path: str, meta: Mapping) -> None:
    row = spark.createDataFrame([tuple(meta.get(f.name) for f in MANIFEST_SCHEMA.fields)],
                                MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def write_version(df: DataFrame, root: str, env: str, name: str, version: str,
                  meta: Mapping | None = None, text_col: str | None = None) -> dict:
    """A7 + A8 + A9: write ``df`` as a new immutable version, verify it by
    reading it back, then write the manifest.  Returns the manifest dict.

    On a digest mismatch the manifest is written with status ``failed`` (the
    evidence stays in place) and ``VerificationFailed`` is raised.
    """
    spark = df.sparkSession
    path = version_path(root, env, name, version)
    if not _claim(spark, path):
        raise VersionConflict(f"version exists: {path}")
    # The digest of what is sent is observed during the write itself (one
    # pass over the source); the digest of what landed is a second,
    # independent aggregation over the files read back.
    obs = Observation("sent")
    df.observe(obs, *_digest_exprs(df, text_col)).write.mode("errorifexists").parquet(f"{path}/data")
    sent = {k: (str(v) if k == "hash_sum" else v) for k, v in obs.get.items()}
    got = digest(spark.read.parquet(f"{path}/data"), text_col).first().asDict()
    info = dict(meta or {})
    info.update(env=env, task_id=name, version_id=version, **got)
    info.setdefault("project_var_versions", {})
    ok = sent == got
    info["status"] = "ok" if ok else "failed"
    _write_manifest(spark, path, info)
    if not ok:
        raise VerificationFailed(f"read-back digest differs at {path}: sent {sent}, read {got}")
    return info


def read_manifest(spark: SparkSession, root: str, env: str, name: str, version: str) -> DataFrame:
    """The manifest row; a missing or corrupt manifest raises."""
    path = version_path(root, env, name, version)
    if not _exists(spark, f"{path}/_manifest"):
        raise FileNotFoundError(f"no manifest at {path}")
    raw = spark.read.text(f"{path}/_manifest")
    parsed = raw.select(F.from_json("value", MANIFEST_SCHEMA, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    none = F.create_map().cast(MANIFEST_SCHEMA["project_var_versions"].dataType)
    return parsed.fillna({"draft_revision_id": "", "baked_by": "", "byte_size": 0}).withColumn(
        "project_var_versions", F.coalesce("project_var_versions", none))


def read_version(spark: SparkSession, root: str, env: str, name: str, version: str) -> DataFrame:
    """A10: the data of one version; missing -> error; a version whose
    manifest says ``failed``, is corrupt or holds more than one row is refused."""
    path = version_path(root, env, name, version)
    # a manifest is exactly one row: reading two parses past the first, so a
    # second (or corrupt) line is caught too
    rows = read_manifest(spark, root, env, name, version).select("status").limit(2).collect()
    if len(rows) != 1:
        raise VerificationFailed(f"manifest must hold one row: {path}")
    if rows[0]["status"] != "ok":
        raise VerificationFailed(f"version not verified: {path}")
    return spark.read.parquet(f"{path}/data")

