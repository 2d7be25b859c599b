"""As-of (effective-dated) lookup (C2), publish history and version locking.

For each left row: the right row with the same keys and the greatest
``right_ts <= left_ts``; among equal ``right_ts`` the smallest ``tie`` (the
first one stored) wins.  Left rows without such a row keep NULLs, and so do
left rows whose time is NULL.  A NULL key matches a NULL key.

Plan: left and right rows are unioned, and one window per key, ordered by
(ts, right before left, tie descending), takes the last right value up to each
left row with ``last_value(ignore nulls)``: one shuffle of each input, rows are
never multiplied and no join follows.  Keys of more than ``max_rows`` rows are
first cut into slots (``sequence.slotted``): there, the last right value of all
*earlier* slots enters a slot as one synthetic row, computed from one partial
aggregation over the rows of such keys alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchwright.operators.sequence import MAX_ROWS, slotted


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str,
               right_ts: str, right_cols: Sequence[str], tie: str | None = None,
               max_rows: int = MAX_ROWS) -> DataFrame:
    """Left columns plus ``right_cols`` (and ``right_ts`` as
    ``matched_<right_ts>``) of the active right row.  ``tie`` must be numeric."""
    keys = list(keys)
    lcols = left.columns
    tie_col = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    val = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c) for c in right_cols])

    r = (right.select(*[F.col(k) for k in keys], F.col(right_ts).cast("timestamp_ntz").alias("_t"),
                      F.lit(0).alias("_kind"), tie_col.isNull().cast("int").alias("_o1"),
                      (-tie_col).alias("_o2"), val.alias("_val"))
              .filter(F.col("_t").isNotNull()))
    whole = F.struct(*[F.col(c) for c in lcols])
    l_ = left.select(*[F.col(k) for k in keys], F.col(left_ts).cast("timestamp_ntz").alias("_t"),
                     F.lit(1).alias("_kind"), F.lit(0).alias("_o1"),
                     F.pmod(F.xxhash64(*lcols), F.lit(1 << 20)).alias("_o2"), whole.alias("_left"))
    order = ["_t", "_kind", "_o1", "_o2"]
    (r, l_), cut = slotted([r, l_], keys, order, max_rows)
    both = r.unionByName(l_, allowMissingColumns=True)
    by = Window.partitionBy(*keys)
    if cut:
        hot = both.where("_b is not null")
        summary = hot.groupBy(*keys, "_b").agg(
            F.max_by("_val", F.when(F.col("_kind") == 0, F.struct(*order))).alias("_last"),
            F.max(F.col("_kind") == 1).alias("_has_left"))
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = (summary.withColumn("_val", F.last("_last", ignorenulls=True).over(earlier))
                 .filter(F.col("_has_left") & F.col("_val").isNotNull()))
        # NULL times sort before every real time of the slot; a slot of left
        # rows without a time is the key's first, and gets no such row
        both = both.unionByName(carry.select(*keys, "_b", "_val", F.lit(0).alias("_kind")), allowMissingColumns=True)
        by = Window.partitionBy(*keys, "_b")
    spec = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_hit", F.last("_val", ignorenulls=True).over(spec)).filter(F.col("_kind") == 1)
    return out.select(*[F.col("_left")[c].alias(c) for c in lcols],
                      *[F.col("_hit")[c].alias(c) for c in right_cols],
                      F.col("_hit")["_rts"].alias(f"matched_{right_ts}"))


def publish_history(versions: DataFrame, rollbacks: DataFrame | None = None) -> DataFrame:
    """E5: every move of a task's published pointer: (task_id, moved_at, kind,
    version_id, move_seq).

    ``versions``: (task_id, version_id, baked_at, status).  Each version that
    was ever published counts at its ``baked_at``, whatever became of it since
    (published, superseded by a later one, or rolled back from).
    ``rollbacks``: (task_id, rolled_at, version_id, rollback_id): the moment,
    and the old version that the pointer went back to.  A rollback counts after
    a publish of the same instant.
    """
    moves = versions.where(F.col("status").isin("published", "superseded", "rolled_back")).select(
        "task_id", F.col("baked_at").alias("moved_at"), F.lit("publish").alias("kind"), "version_id",
        F.struct(F.lit(0).alias("rank"), F.col("version_id").cast("long").alias("id")).alias("move_seq"))
    if rollbacks is not None:
        moves = moves.unionByName(rollbacks.select(
            "task_id", F.col("rolled_at").alias("moved_at"), F.lit("rollback").alias("kind"), "version_id",
            F.struct(F.lit(1).alias("rank"), F.col("rollback_id").cast("long").alias("id")).alias("move_seq")))
    return moves


def pointer_moves(history: DataFrame) -> DataFrame:
    """The history with one row per (task, moment): the version that the
    pointer stands on after all moves of that moment."""
    return history.groupBy("task_id", "moved_at").agg(
        F.max_by(F.struct("version_id", "kind"), "move_seq").alias("_m"), F.count(F.lit(1)).alias("n_moves")) \
        .select("task_id", "moved_at", "_m.version_id", "_m.kind", "n_moves")


def lock_versions(instances: DataFrame, history: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The version each instance runs.

    ``instances``: (attempt_id, instance_id, task_id, created_at, explicit_version).
    ``history``: ``publish_history``.

    The lock is taken at the instance's first attempt (earliest created_at,
    then attempt_id): an explicit version (backfill) wins, else the version
    that the task's published pointer stands on at that moment.  Retries reuse
    it.  The first attempt is found with a partial aggregation and only those
    rows go through the as-of join; the lock is then joined back to every attempt.
    """
    firsts = (instances.groupBy("instance_id")
              .agg(F.min_by(F.struct("task_id", "created_at", "explicit_version"),
                            F.struct("created_at", "attempt_id")).alias("f"))
              .select("instance_id", "f.task_id", "f.created_at", "f.explicit_version"))
    looked = as_of_join(firsts, pointer_moves(history), keys=["task_id"], left_ts="created_at",
                        right_ts="moved_at", right_cols=["version_id"], max_rows=max_rows)
    lock = looked.select(
        F.col("instance_id").alias("_instance"),
        F.coalesce(F.col("explicit_version"), F.col("version_id")).alias("locked_version"),
        F.when(F.col("explicit_version").isNotNull(), F.lit("explicit"))
         .when(F.col("version_id").isNotNull(), F.lit("published"))
         .otherwise(F.lit("none")).alias("lock_source"))
    return instances.join(lock, F.col("instance_id").eqNullSafe(F.col("_instance")), "left").drop("_instance")
