"""Event streams. The same functions run on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.relational import snapshot_diff

LATE = "10 minutes"


def _timed(events: DataFrame, late: str = LATE) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of value by type in tumbling (or, with slide, sliding) windows: start, event_type, n, total."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = _timed(events).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, closed after a gap: user_id, start, n, total."""
    grouped = _timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events without repeated ids; on a stream, within the watermark."""
    return _timed(events).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def watch(snapshots: DataFrame, last: Callable[[], DataFrame], report: Callable[[DataFrame], None], key: str, value: str, every: str = "5 seconds", most: int = 20_000, checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch is a snapshot: its changes against last() go to report(). More rows than `most` stop the query."""

    def step(batch: DataFrame, _: int) -> None:
        if batch.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} rows in a snapshot")
        report(snapshot_diff(last(), batch, key, value).where("change <> 'same'"))

    writer = snapshots.writeStream.foreachBatch(step).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of event files."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path)
