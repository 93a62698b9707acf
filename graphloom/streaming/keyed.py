"""Changes of keyed snapshots as a stream with state: what is new, what has another digest, what is gone.

Each row of a snapshot has its key, its digest and the snapshot's time; a snapshot lists everything that is there. State holds one
digest and one time for each key, in RocksDB, so it may be larger than memory and is dealt over the executors by key. A key that the
next snapshot does not have is gone: its timer is set just after its own time, is moved when the key is seen again, and fires
as soon as the watermark has passed it, which is when a later snapshot has been read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graphloom.storage import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "key string, change string, digest string, at timestamp"


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "digest string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] is None:
            return  # it only tells a snapshot's time
        for row in sorted(rows, key=lambda r: (r.at_ms, r.digest or "")):
            last = self.state.get() if self.state.exists() else None
            if last is not None:
                if row.at_ms < last[1]:
                    continue  # an older snapshot came late
                self.handle.deleteTimer(last[1] + 1)
            if last is None or last[0] != row.digest:
                yield Row(key=key[0], change="added" if last is None else "changed", digest=row.digest, at=row.at)
            self.state.update((row.digest, row.at_ms))
            self.handle.registerTimer(row.at_ms + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        import datetime

        digest, at = self.state.get()
        self.state.clear()
        yield Row(key=key[0], change="removed", digest=digest, at=datetime.datetime.fromtimestamp(at / 1000))

    def close(self) -> None:
        pass


def changes(snapshots: DataFrame, key: str = "key", digest: str = "digest", at: str = "at") -> DataFrame:
    """snapshots: a stream of key, digest, at (the time of the row's snapshot). key, change (added, changed, removed), digest, at.

    at of a removed key is that of the last snapshot that had it. Of several digests of a key in one snapshot the greatest is the
    last, and each differs from the one before. A row of a null key only tells a snapshot's time; a null digest is a digest. Snapshots that are
    read in one batch are taken in the order of their times, but a key that is missing in one of them only counts as there. The
    session has to use the RocksDB state store: see prepared().
    """
    ship_package(snapshots.sparkSession)
    rows = snapshots.select(F.col(key).cast("string").alias("key"), F.col(digest).cast("string").alias("digest"), F.col(at).cast("timestamp").alias("at"))
    timed = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", "0 seconds")
    return timed.groupBy("key").transformWithState(_Changes(), CHANGES, "append", "EventTime")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state needs; queries that start later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def batch_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same between two snapshots as tables (key, digest): key, change, digest."""
    both = old.select("key", F.col("digest").alias("a"), F.lit(True).alias("was")).join(new.select("key", F.col("digest").alias("b"), F.lit(True).alias("is")), "key", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("key", change.alias("change"), F.when(F.col("is").isNull(), F.col("a")).otherwise(F.col("b")).alias("digest")).where("change IS NOT NULL")


def watched(snapshots: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the changes of a stream of snapshots to a folder of Parquet files; with `once` until what is there has been read."""
    writer = changes(snapshots).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
