"""Keep-one-row-per-key operators.

``latest_by`` is ``row_number() = 1`` over a window.  Spark plans a filter
``rn = 1`` over a ranking window as WindowGroupLimit: a partial limit runs on
each input partition *before* the shuffle, so at most one row per key and map
task crosses the network.  A key holding a third of all rows therefore reaches
its reducer as (number of map tasks) rows, not as a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def latest_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column],
              rank_col: str = "_rn") -> DataFrame:
    """One row per ``keys``, the first under ``order``.

    ``order`` must decide every output column (add a unique tie-breaker) or the
    kept row is not deterministic.  Use ``desc_nulls_last()`` /
    ``asc_nulls_first()`` explicitly where NULLs occur.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) == 1)
              .drop(rank_col))


def dedupe_triggers(triggers: DataFrame,
                    keys: Sequence[str] = ("task_id", "biz_date", "trigger_source", "scheduled_at"),
                    order: Sequence[str] = ("created_at", "instance_id")) -> DataFrame:
    """Repeats of (task, date, source, scheduled_at) resolve to the first
    created instance; every repeat reports which instance it maps to.

    Returns one row per trigger row with ``first_instance_id`` and
    ``is_duplicate``; NULL equals NULL in the key (a manual trigger has no
    scheduled time).  The first instance per key is found with a
    partial-aggregated ``min_by`` (no sort of the hot key), then joined back.
    """
    firsts = (triggers.groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
              .agg(F.min_by(F.col("instance_id"), F.struct(*[F.col(c) for c in order]))
                   .alias("first_instance_id")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = triggers.join(firsts, same).drop(*[f"_{k}" for k in keys])
    return out.withColumn("is_duplicate", F.col("instance_id") != F.col("first_instance_id"))


def current_state(events: DataFrame, key: str = "instance_id", state: str = "state",
                  order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The state of the last event per instance.  ``max_by`` aggregates with
    a map-side partial step, so a hot instance does not land whole on one task."""
    return (events.groupBy(key)
            .agg(F.max_by(F.col(state), F.struct(*[F.col(c) for c in order])).alias("current_state"),
                 F.count(F.lit(1)).alias("n_events")))


def first_result(df: DataFrame, keys: Sequence[str], ts: str, value: str,
                 out: str = "first_result") -> DataFrame:
    """Idempotent publish: per (task, revision, idempotency key) the result
    of the earliest request (ties by value), plus how many requests repeated it."""
    return (df.groupBy(*keys)
            .agg(F.min_by(F.col(value), F.struct(F.col(ts), F.col(value))).alias(out),
                 F.count(F.lit(1)).alias("n_requests")))
