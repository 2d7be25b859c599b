"""Session construction and the shared scratch location.

Jobs never pick a machine-local folder on their own: intermediate tables and
read-back checks go below the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests) is a
fresh temporary folder created and registered as the checkpoint dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession


# Settings for a large cluster (100 TB inputs, ~1000 executors).  Shuffle
# partitions start high and AQE coalesces them to ~256 MB each at run time;
# scans split files into 256 MB partitions; skewed join partitions are split.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> SparkSession:
    """Apply ``CLUSTER_CONF`` (plus overrides) to a running session, e.g. one
    created by spark-submit on the cluster."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)
    return spark


def configured_master() -> str | None:
    """The master that the launcher or a running session has set, if any."""
    active = SparkSession.getActiveSession()
    return active.sparkContext.master if active else SparkConf().get("spark.master", None)


def is_local(master: str) -> bool:
    """One machine, one process: its temporary folder is all executors' folder too."""
    return master == "local" or master.startswith("local[")


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "batchwright", extra: dict | None = None) -> SparkSession:
    """Session with the settings the library assumes.

    * AQE on (coalescing, skew-join splitting) so partition counts adapt at run time.
    * Session zone pinned to UTC: business dates never depend on the machine zone.
    * Spark UI off: nothing listens on a port besides Spark's own RPC.

    A master that the launcher has set (``spark-submit --master``, a running
    session) is kept; local threads are the choice only where nothing is set.
    On a cluster ``CLUSTER_CONF`` is applied, and ``extra`` over it.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    given = master or configured_master()
    if given and not is_local(given):
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        if shuffle_partitions:
            extra = {"spark.sql.shuffle.partitions": str(shuffle_partitions), **(extra or {})}
        return apply_cluster_conf(builder.getOrCreate(), extra)
    builder = (
        SparkSession.builder.master(given or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Local data is small: without this AQE merges a rebalance before a
        # partitioned write into one or two tasks, which then open every
        # partition's file one after another.  Cluster sizes: CLUSTER_CONF.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", str(64 << 10))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only where it is
    unset and the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current:
            sc.setCheckpointDir(current)
    if not current:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="batchwright-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/batchwright/{name}-{uuid.uuid4().hex[:12]}"
