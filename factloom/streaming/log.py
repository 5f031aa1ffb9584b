"""The event log as a stream: windows, late data, and state that follows it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settle import shared_dir


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Files of events as they come, with ts as a timestamp."""
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", keys: tuple = ("event_type",)) -> DataFrame:
    """Counts and sums a tumbling (or sliding) window and key; events later than the watermark are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", keys: tuple = ("user_id",)) -> DataFrame:
    """Sessions of a key: runs of events less than a gap apart."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("w_start"), F.col("session_window.end").alias("w_end"), *keys, "n")


def last_values(events: DataFrame, key: str = "user_id", value: str = "event_type") -> DataFrame:
    """The latest value of each key: cardinality one, kept up to date (output mode complete or update)."""
    return events.groupBy(key).agg(F.max_by(F.col(value), F.struct("ts", "event_id")).alias(value), F.max("ts").alias("ts"))


def follow(stream: DataFrame, on_batch, checkpoint: str, available_now: bool = True):
    """Runs on_batch(frame, id) for every micro-batch, once each by its id in the checkpoint."""
    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def to_memory(frame: DataFrame, name: str, mode: str) -> DataFrame:
    """A finished run of a small stream into an in-memory table, with its state in the shared folder."""
    state = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)
