"""Trigger dedupe (H21) on a stream of trigger rows.

Batch ``operators.dedup.dedupe_triggers`` maps every repeat to the first
instance.  On a stream the same rule (the first trigger of a (task, date,
source, scheduled_at) key wins, repeats are dropped) is Structured
Streaming's ``dropDuplicatesWithinWatermark``: state per key lives in the
state store only until the watermark passes, so state stays bounded however
long the stream runs, and a checkpoint location makes it survive restarts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

KEYS = ("task_id", "biz_date", "trigger_source", "scheduled_at")


def first_triggers(stream: DataFrame, keys: Sequence[str] = KEYS, event_time: str = "created_at",
                   delay: str = "1 hour") -> DataFrame:
    """Streaming: keep the first trigger per key; repeats arriving within
    ``delay`` of the watermark are dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def start(stream: DataFrame, sink_path: str, checkpoint: str, **kw):
    """Run ``first_triggers`` into a parquet sink (append mode, exactly once
    through the checkpoint)."""
    return (first_triggers(stream, **kw).writeStream.format("parquet")
            .option("path", sink_path).option("checkpointLocation", checkpoint)
            .outputMode("append").start())
