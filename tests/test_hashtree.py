"""Versions compared by their trees: the rows, and what is read for them."""

import re

import pytest
from pyspark.sql import functions as F

from batchwright.operators.lifecycle import compare_runs
from batchwright.sources import hashtree as H
from batchwright.sources import writers as W


def leaves_of(df):
    """The leaves that rows come from; the scan must pick folders by partition, not rows."""
    assert re.search(r"PartitionFilters: \[[^]]*leaf", df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    return {int(re.search(r"leaf=(\d+)", r[0])[1]) for r in df.select(F.input_file_name()).distinct().collect()}


def test_one_changed_row_reads_one_leaf(spark, tmp_path):
    df = spark.range(20000).select("id", (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise("s").alias("y"))
    old, same, new = (str(tmp_path / n) for n in ("old", "same", "new"))
    H.write_tree(df, old, ["id"])
    H.write_tree(df.repartition(5).orderBy(F.desc("x")), same, ["id"])
    H.write_tree(df.withColumn("x", F.when(F.col("id") == 4711, F.lit(99)).otherwise(F.col("x"))), new, ["id"])
    assert H.differing_leaves(spark, old, same) == [] and H.compare_versions(spark, old, same, ["id"], ["x", "y"]).count() == 0
    leaves = H.differing_leaves(spark, old, new)
    assert len(leaves) == 1
    for side in H.changed_rows(spark, old, new, leaves):
        assert leaves_of(side) == set(leaves) and side.count() < 400
    assert [tuple(r) for r in H.compare_versions(spark, old, new, ["id"], ["x", "y"]).collect()] == [(4711, "changed", "x", 1, 1)]


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_same_as_comparing_all_rows(spark, tmp_path, levels):
    a = [(i % 40 if i % 11 else None, i % 3, None if i % 5 == 0 else str(i)) for i in range(200)]
    b = [(k, (x + (k == 7)) if k is not None else x, s) for k, x, s in a if k != 9] + [(1000, 1, None), (None, 1, "more")]
    sides = [spark.createDataFrame(r, "k long, x long, s string") for r in (a, b)]
    paths = [str(tmp_path / n) for n in "ab"]
    for df, p in zip(sides, paths):
        H.write_tree(df, p, ["k"], levels)
    want = compare_runs(*sides, ["k"], ["x", "s"]).where("status <> 'same'").collect()
    got = H.compare_versions(spark, *paths, ["k"], ["x", "s"]).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and {r["k"] for r in got} == {None, 7, 9, 1000}


def test_null_and_value_swapped_is_a_difference(spark, tmp_path):
    paths = [str(tmp_path / n) for n in "ab"]
    for rows, p in (([(1, "v", None)], paths[0]), ([(1, None, "v")], paths[1])):
        H.write_tree(spark.createDataFrame(rows, "k long, x string, y string"), p, ["k"])
    assert [r["changed_cols"] for r in H.compare_versions(spark, *paths, ["k"], ["x", "y"]).collect()] == ["x,y"]
    H.write_tree(spark.createDataFrame([(1, "v")], "k long, x string"), str(tmp_path / "c"), ["k"], 1)
    with pytest.raises(ValueError):
        H.differing_leaves(spark, paths[0], str(tmp_path / "c"))
