"""Ordered per-key operators that stay parallel when one key is huge.

* ``previous_value``: the value of the previous row in (ts, tie) order
  (``lag``), E3;
* ``forward_fill``: the last non-NULL value up to the current row, E5;
* ``running_peak``: the maximum of a running sum of +1/-1 deltas, E6.

A key of at most ``max_rows`` rows is handled by one plain window: one shuffle
and one sort.  Only keys above that are cut into slots (``slotted``), whatever
the types of the order columns and however many rows share an instant, and only
their slots have a summary, from which the value carried over from earlier
slots is computed and enters the window as one synthetic row per slot.  NULL
keys are keys like any other: nothing is matched by ``=``.

A NULL time comes first, before all times, in the order of the tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchwright.session import scratch_path

# A key with more rows than this is cut.
MAX_ROWS = 2_000_000
_OVERSPLIT = 4


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slotted(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str],
            max_rows: int = MAX_ROWS) -> tuple[list[DataFrame], bool]:
    """Adds ``_b`` to every frame: a number that grows with ``order`` inside a
    key, NULL for keys that are not cut; and tells whether any key is.

    Only the rows of keys above the bound move: they are range-partitioned by
    key, the order columns (of any type that sorts, NULLs first) and their place
    in the input, and written with the number of their partition, which is the
    slot.  So a key is cut wherever its rows lie: at one instant, without times,
    over any span.  Ranges come from a sample of the rows, so a slot holds about
    ``max_rows`` / 4 rows.  All frames must have the keys and the order columns.

    Keys above the bound are at most as many as rows / ``max_rows``, so their
    table is small at any size and is broadcast.
    """
    keys, order = list(keys), list(order)
    rows = frames[0].select(*keys)
    for f in frames[1:]:
        rows = rows.unionByName(f.select(*keys))
    large = _written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows).coalesce(1), "large")
    total = large.agg(F.sum("_n")).first()[0]
    if not total:
        return [f.withColumn("_b", F.lit(None).cast("int")) for f in frames], False
    names = F.broadcast(large.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(keys)]))
    same = F.lit(True)
    for j, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{j}"))
    moved = None
    for i, f in enumerate(frames):
        one = f.join(names, same, "left_semi").select(
            *keys, *order, F.lit(i).alias("_frame"), F.struct(*f.columns).alias(f"_row{i}"))
        moved = one if moved is None else moved.unionByName(one, allowMissingColumns=True)
    parts = -(-total // max_rows) * _OVERSPLIT
    slots = _written(moved.withColumn("_place", F.monotonically_increasing_id())
                     .repartitionByRange(parts, *keys, *order, "_place")
                     .withColumn("_b", F.spark_partition_id()), "slots")
    return [f.join(names, same, "left_anti").withColumn("_b", F.lit(None).cast("int")).unionByName(
        slots.where(F.col("_frame") == i).select(f"_row{i}.*", "_b")) for i, f in enumerate(frames)], True


def _with_carry(b: DataFrame, carry: DataFrame, value: str) -> DataFrame:
    """Real rows (``_syn`` 1) plus one synthetic row (``_syn`` 0) holding the
    carried value in ``value`` for every slot in ``carry``."""
    synth = carry.select(*[c for c in carry.columns if c != "_carry"],
                         F.col("_carry").alias(value), F.lit(0).alias("_syn"))
    return b.withColumn("_syn", F.lit(1)).unionByName(synth, allowMissingColumns=True)


def previous_value(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str,
                   out: str = "prev", max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``out`` = ``value`` of the previous row of the same key in
    (ts, tie) order; NULL for the first row of a key."""
    keys = list(keys)
    [b], cut = slotted([df], keys, [ts, tie], max_rows)
    if not cut:
        return b.drop("_b").withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(ts, tie)))
    # the last value of each slot; then per key that of the slot before
    last = F.max_by(F.struct(F.col(value)), F.struct(F.col(ts), F.col(tie))).alias("_last")
    wk = Window.partitionBy(*keys).orderBy("_b")
    carry = (b.where("_b is not null").groupBy(*keys, "_b").agg(last)
             .withColumn("_carry", F.lag("_last").over(wk))
             .where(F.col("_carry").isNotNull()).select(*keys, "_b", F.col("_carry")[value].alias("_carry")))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("_syn"), F.col(ts), F.col(tie))
    return (_with_carry(b, carry, value).withColumn(out, F.lag(value).over(w))
            .filter(F.col("_syn") == 1).drop("_b", "_syn"))


def forward_fill(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str,
                 out: str = "filled", max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``out`` = last non-NULL ``value`` at or before the current row."""
    keys = list(keys)
    [b], cut = slotted([df], keys, [ts, tie], max_rows)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if not cut:
        w = Window.partitionBy(*keys).orderBy(ts, tie).rowsBetween(*so_far)
        return b.drop("_b").withColumn(out, F.last(value, ignorenulls=True).over(w))
    v = F.col(value)
    last = F.max_by(v, F.when(v.isNotNull(), F.struct(F.col(ts), F.col(tie)))).alias("_last")
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (b.where("_b is not null").groupBy(*keys, "_b").agg(last)
             .withColumn("_carry", F.last("_last", ignorenulls=True).over(wk))
             .where(F.col("_carry").isNotNull()).select(*keys, "_b", "_carry"))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("_syn"), F.col(ts), F.col(tie)).rowsBetween(*so_far)
    return (_with_carry(b, carry, value).withColumn(out, F.last(value, ignorenulls=True).over(w))
            .filter(F.col("_syn") == 1).drop("_b", "_syn"))


def running_peak(deltas: DataFrame, keys: Sequence[str], ts: str, delta: str, tie: str,
                 max_rows: int = MAX_ROWS) -> DataFrame:
    """Per key: the maximum of the running sum of ``delta`` in (ts, delta, tie)
    order (at equal times -1 comes before +1, so an end and a start at the
    same instant do not overlap)."""
    keys = list(keys)
    [b], cut = slotted([deltas], keys, [ts, delta, tie], max_rows)
    w = (Window.partitionBy(*keys, "_b").orderBy(F.col(ts), F.col(delta), F.col(tie))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not cut:
        w = (Window.partitionBy(*keys).orderBy(F.col(ts), F.col(delta), F.col(tie))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return (b.withColumn("_run", F.sum(delta).over(w))
                .groupBy(*keys).agg(F.max("_run").cast("long").alias("peak_running")))
    local = (b.withColumn("_run", F.sum(delta).over(w))
              .groupBy(*keys, "_b").agg(F.max("_run").alias("_peak"), F.sum(delta).alias("_total")))
    wk = (Window.partitionBy(*keys).orderBy("_b")
          .rowsBetween(Window.unboundedPreceding, -1))
    return (local.withColumn("_offset", F.coalesce(F.sum("_total").over(wk), F.lit(0)))
                 .groupBy(*keys).agg(F.max(F.col("_offset") + F.col("_peak")).cast("long").alias("peak_running")))
