"""Why an instance waits (C7): from each waiting instance to the first cause.

An instance that has not succeeded waits if an upstream instance it needs has
not succeeded either.  Its blocker is the smallest such upstream (task, day).
A blocker that does not exist is the cause ``missing``; one that failed although
all its own upstreams succeeded is the cause ``failed``; one that waits itself
leads on to its own blocker.  Chains that never end run in a ``cycle``, named by
its smallest instance.

Every instance has one pointer, to its blocker.  Pointers are doubled: each
round replaces a pointer by that of the instance pointed to, so after r rounds
chains of length 2^r are resolved; rounds grow with the logarithm of the longest
chain.  Once a round resolves nothing, what is left leads to cycles: every
chain has instances at all smaller depths, so no longer chain can follow.  Those
go on, with the smallest instance on their way and that on the way from where
they point, until neither changes: the second is then the cycle's smallest.
Resolved instances leave the join, and each round is written below the
checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.operators.sequence import _written


def waiting_causes(instances: DataFrame, deps: DataFrame, task: str = "task_id", day: str = "biz_date",
                   ok: str = "ok", order: Sequence[str] = ()) -> DataFrame:
    """(task, day, cause, cause_task, cause_date, depth) of every waiting instance.

    Attempts count as in ``lifecycle.ready``: the last one under ``order``, or
    without it any that succeeded.  ``deps``: (task, upstream_id, offset).
    ``depth`` is the number of steps to the cause, NULL for a cycle.  Rows
    without a task or day take no part.
    """
    outcome = F.coalesce(F.max_by(ok, F.struct(*order)) if order else F.bool_or(ok), F.lit(False))
    node = F.struct(F.col(task).alias("t"), F.col(day).alias("d"))
    final = _written(instances.where(F.col(task).isNotNull() & F.col(day).isNotNull()).groupBy(task, day)
                     .agg(outcome.alias("_ok")).select(node.alias("node"), "_ok"), "waiting-instances")
    need = deps.where(F.col("upstream_id").isNotNull()).select(F.col(task).alias("_t"), "upstream_id", "offset").distinct()
    asked = final.where(~F.col("_ok")).join(need, F.col("node.t") == F.col("_t")).select(
        "node", F.struct(F.col("upstream_id").alias("t"), F.date_sub(F.col("node.d"), F.col("offset")).alias("d")).alias("up"))
    known = final.select(F.col("node").alias("up"), F.col("_ok").alias("_up_ok"))
    blocked = _written(asked.join(known, "up", "left").where(~F.coalesce("_up_ok", F.lit(False)))
                       .groupBy("node").agg(F.min(F.struct("up", F.col("_up_ok").isNull().alias("missing"))).alias("b"))
                       .select("node", F.col("b.up").alias("at"), F.col("b.missing").alias("missing")), "waiting-blocked")
    # a blocker that waits itself is no cause
    waits = blocked.select(F.col("node").alias("at"), F.lit(True).alias("_waits"))
    start = blocked.join(waits, "at", "left").select(
        "node", "at", F.lit(1).cast("long").alias("steps"), F.least("node", "at").alias("least"),
        F.when(F.col("missing"), F.lit("missing")).when(F.col("_waits").isNull(), F.lit("failed")).alias("cause"))
    start = _written(start, "waiting-round")
    done, left = [start.where("cause is not null")], start.where("cause is null")
    n, mark, cycles = left.count(), None, False
    while n:
        # an instance's pointer, whether its own chain is resolved or not
        via = left.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"),
                          F.col("least").alias("_least"), F.col("cause").alias("_cause"))
        if not cycles:
            for d in done:
                via = via.unionByName(d.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"),
                                               F.col("least").alias("_least"), F.col("cause").alias("_cause")))
        now = _written(left.join(via, "at").select(
            "node", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"),
            F.least("least", "_least").alias("least"), F.col("_cause").alias("cause"), F.col("_least").alias("name")), "waiting-round")
        if cycles:
            left = now
            seen = left.agg(F.sum(F.xxhash64("node", "least", "name").cast("decimal(38,0)"))).first()[0]
            if seen == mark:
                break
            mark = seen
            continue
        done.append(now.where("cause is not null").drop("name"))
        left = now.where("cause is null")
        m = left.count()
        cycles, n = m == n, m
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if n:
        out = out.unionByName(left.select("node", F.col("name").alias("at"), F.lit(None).cast("long").alias("steps"), "least",
                                          F.lit("cycle").alias("cause")))
    return out.select(F.col("node.t").alias(task), F.col("node.d").alias(day), "cause", F.col("at.t").alias("cause_task"),
                      F.col("at.d").alias("cause_date"), F.col("steps").alias("depth"))
