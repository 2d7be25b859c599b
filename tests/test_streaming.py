"""Streaming trigger dedupe over the events table read as a file stream."""

from pyspark.sql import functions as F

from batchwright.plans import standins as S
from batchwright.session import scratch_path
from batchwright.streaming.triggers import start
from conftest import SMALL


def test_stream_keeps_one_trigger_per_key(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    src = scratch_path(spark, "t-stream-src")
    S.triggers(events).withColumn("created_at", F.col("created_at").cast("timestamp")) \
        .drop("application_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    sink, ckpt = scratch_path(spark, "t-stream-out"), scratch_path(spark, "t-stream-ckpt")
    q = start(stream, sink, ckpt)
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(sink)
    keys = ["task_id", "biz_date", "trigger_source", "scheduled_at"]
    assert out.count() == spark.read.parquet(src).select(*keys).distinct().count()
    assert out.groupBy(*keys).count().filter("count > 1").count() == 0
