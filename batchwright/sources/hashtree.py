"""Versions compared by a tree of digests (A8 with C8 / C9).

A version's rows lie in folders by a hash of their key, the leaves.  Each leaf
has a digest (number of rows, sum and xor of two row hashes), computed from what
was read back; sums and xors combine upward, ``FANOUT`` nodes to one, so every
level has its digests and the root stands for the whole version.  A comparison
descends only below nodes that differ and reads the rows of differing leaves
alone.  Digests depend neither on the order of rows nor on files.

A tree of ``levels`` has ``FANOUT ** levels`` leaves, whatever the data; that
number bounds what the driver sees.  A leaf with a hot key is split into files
as any large partition.  NULL keys are keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.operators.lifecycle import compare_runs
from batchwright.sources import writers as W

FANOUT = 16
LEAF = "leaf"
DIGEST = ("n", "sum", "xor")


def _hash(cols: Sequence[str], seed: int) -> Column:
    # a NULL changes no hash, so its place is hashed too
    return F.xxhash64(F.lit(seed), *[x for c in sorted(cols) for x in (F.col(c).isNull(), F.col(c))])


def write_tree(df: DataFrame, path: str, keys: Sequence[str], levels: int = 2) -> None:
    """Writes the rows below ``path``/rows and the digests of all levels below ``path``/digests."""
    spark = df.sparkSession
    leaf = F.pmod(_hash(keys, 0), F.lit(FANOUT ** levels)).cast("string")
    W.overwrite_table(df.withColumn(LEAF, leaf), f"{path}/rows", partition_cols=[LEAF])
    cols = df.columns
    node = W.read_table(spark, f"{path}/rows", partition_cols=[LEAF]).groupBy(F.col(LEAF).cast("long").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_hash(cols, 1).cast("decimal(38,0)")).alias("sum"), F.bit_xor(_hash(cols, 2)).alias("xor"))
    W.overwrite_table(node.withColumn("level", F.lit(levels)), f"{path}/leaves")
    leaves = W.read_table(spark, f"{path}/leaves")
    below = leaves
    for level in range(levels - 1, -1, -1):
        below = below.unionByName(leaves.groupBy(F.expr(f"node div {FANOUT ** (levels - level)}").alias("node")).agg(
            F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"), F.bit_xor("xor").alias("xor"))
            .withColumn("level", F.lit(level)))
    W.overwrite_table(below, f"{path}/digests")


def differing_leaves(spark: SparkSession, old: str, new: str) -> list[int]:
    """The leaves whose rows differ, found from the root down."""
    a, b = (W.read_table(spark, f"{p}/digests") for p in (old, new))
    depth = [d.agg(F.max("level")).first()[0] for d in (a, b)]
    if None not in depth and depth[0] != depth[1]:
        raise ValueError(f"the trees have {depth[0]} and {depth[1]} levels")
    levels = max((d for d in depth if d is not None), default=0)
    side = lambda d, name: d.select("level", "node", F.struct(*DIGEST).alias(name))
    differ = side(a, "a").join(side(b, "b"), ["level", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    nodes = [r["node"] for r in differ.where("level = 0").collect()]
    for level in range(1, levels + 1):
        if not nodes:
            break
        at = differ.where(F.col("level") == level).where(F.expr(f"node div {FANOUT}").isin(nodes))
        nodes = sorted(r["node"] for r in at.collect())
    return nodes


def changed_rows(spark: SparkSession, old: str, new: str, leaves: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """The rows of these leaves in either version; other folders aren't read."""
    names = [str(x) for x in leaves]
    pick = F.col(LEAF).isin(names) if names else F.lit(False)
    return tuple(W.read_table(spark, f"{p}/rows", partition_cols=[LEAF]).where(pick).drop(LEAF) for p in (old, new))


def compare_versions(spark: SparkSession, old: str, new: str, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """C9 on two stored versions: the keys that are not the same, as ``compare_runs`` reports them."""
    a, b = changed_rows(spark, old, new, differing_leaves(spark, old, new))
    return compare_runs(a, b, keys, cols).where("status <> 'same'")
