"""allow/deny policy over Spark conf rows.

A key is ``blacklisted`` when it equals a deny key or starts with a deny
prefix (deny always wins), ``not in whitelist`` when it neither equals an
allow key nor starts with an allow prefix, otherwise ``accepted``.

The lists are short, fixed policy, so the check is a column expression
(``isin`` and ``startswith``) evaluated inside the scan's projection: no join,
no shuffle, no broadcast.  Lists supplied by a caller are turned into the same
expression; they are configuration, bounded by what a person writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The conf policy.
ALLOW_PREFIXES = (
    "spark.sql.",
    "spark.shuffle.",
    "spark.dynamicAllocation.",
    "spark.executor.memory",
    "spark.driver.memory",
    "spark.yarn.appMasterEnv.",
    "spark.executorEnv.",
    "spark.hadoop.hive.exec.dynamic.partition",
)
ALLOW_KEYS = ("spark.executor.cores", "spark.driver.cores")
DENY_KEYS = (
    "spark.driver.extraJavaOptions",
    "spark.executor.extraJavaOptions",
    "spark.driver.extraClassPath",
    "spark.driver.extraLibraryPath",
    "spark.executor.extraClassPath",
    "spark.executor.extraLibraryPath",
    "spark.yarn.principal",
    "spark.yarn.keytab",
)
DENY_PREFIXES = ("spark.yarn.dist.", "spark.kerberos.", "spark.security.credentials.")

BLACKLISTED = "blacklisted"
NOT_ALLOWED = "not in whitelist"
ACCEPTED = "accepted"


def _matches(key: Column, keys: Sequence[str], prefixes: Sequence[str]) -> Column:
    cond = key.isin(*keys) if keys else F.lit(False)
    for p in prefixes:
        cond = cond | key.startswith(p)
    return cond


def verdict(key: str | Column, allow_keys: Sequence[str] = ALLOW_KEYS,
            allow_prefixes: Sequence[str] = ALLOW_PREFIXES, deny_keys: Sequence[str] = DENY_KEYS,
            deny_prefixes: Sequence[str] = DENY_PREFIXES) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (F.when(_matches(k, deny_keys, deny_prefixes), F.lit(BLACKLISTED))
             .when(~_matches(k, allow_keys, allow_prefixes), F.lit(NOT_ALLOWED))
             .otherwise(F.lit(ACCEPTED)))


def policy_check(conf: DataFrame, key: str = "key", **lists) -> DataFrame:
    """Per conf row: ``verdict``."""
    return conf.withColumn("verdict", verdict(key, **lists))


def task_policy(conf: DataFrame, task: str = "task_id", key: str = "key", **lists) -> DataFrame:
    """Per task: accepted when no key is rejected, with the rejected keys as
    ``key: reason`` sorted by key (a publish is refused on any rejection)."""
    checked = policy_check(conf, key, **lists)
    rejected = F.when(F.col("verdict") != ACCEPTED,
                      F.concat(F.col(key), F.lit(": "), F.col("verdict")))
    return (checked.groupBy(task)
            .agg(F.count(F.lit(1)).alias("n_keys"),
                 F.array_join(F.array_sort(F.collect_set(rejected)), ", ").alias("rejected"))
            .withColumn("accepted", F.col("rejected") == ""))
