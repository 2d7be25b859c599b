"""A1: table scans by name.

The test tables are one parquet file each; in production the same names are
metastore tables.  Reads are lazy so Catalyst prunes columns and pushes
filters into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read table ``name`` from a directory of ``<name>.parquet`` files, or a
    metastore table when ``sf_dir`` is empty."""
    if not sf_dir:
        return spark.table(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
