"""Structured Streaming twins of the batch operators over events.

A finite input is drained with ``availableNow``; every batch writes a folder of its own under the shared checkpoint folder
(a batch that is done again replaces it), and the result is read back from there. Windows and sessions are emitted
once the watermark has closed them, which is when their state is dropped; counters are emitted when they change, and
readers take the newest of each key. Nothing is collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.session import ensure_checkpoint_dir
from lorekeep.streaming import log

LATENESS = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Files that arrive at a path, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with an event time that watermarks accept."""
    path = f"{sf_dir}/events.parquet"
    # as a pattern, the path may be a file or a folder
    return read_stream(spark, f"{sf_dir}/[e]vents.parquet", spark.read.parquet(path).schema).withColumn("at", F.col("ts").cast("timestamp"))


def repeated(stream: DataFrame, every: str) -> DataFrame:
    """The stream with some of its rows delivered a second time."""
    return stream.unionByName(stream.where(every))


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What a stream has given once all that is available is read; with ``keys`` the newest row of each."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, number: log.write_batch(df, f"{base}/out", number)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if keys:
        return log.latest(spark, f"{base}/out", stream.schema, keys)
    return log.read_log(spark, f"{base}/out", stream.schema).drop(log.BATCH)


def daily_counts(stream: DataFrame) -> DataFrame:
    """Events per type and UTC day."""
    return stream.withWatermark("at", LATENESS).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.to_date("window.start").alias("day"), "n")


def minute_windows(stream: DataFrame) -> DataFrame:
    """Requests per user and UTC minute: the counters of the rate limits."""
    return stream.withWatermark("at", LATENESS).groupBy(F.window("at", "1 minute"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("minute"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user by a gap in event time."""
    return stream.withWatermark("at", LATENESS).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")


def once_each(stream: DataFrame) -> DataFrame:
    """Events by id, each once while the watermark remembers it."""
    return stream.withWatermark("at", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def matched(stream: DataFrame, subscriptions: DataFrame, key: str) -> DataFrame:
    """A stream against standing queries: a stream-static join whose static side is read anew in every batch."""
    return stream.join(subscriptions, key, "inner")


def admitted(stream: DataFrame, per_day: int) -> DataFrame:
    """``user_id, event_id, admitted`` by a counter of each user's UTC day, which ends its state; events without user or time are left out."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        used = state.get[0] if state.exists else 0
        good = [used + i < per_day for i in range(len(rows))]
        state.update((used + sum(good),))
        state.setTimeoutTimestamp((int(pd.Timestamp(key[1]).timestamp()) + 2 * 86_400) * 1000)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "admitted": good})

    days = stream.where("at IS NOT NULL AND user_id IS NOT NULL").withWatermark("at", LATENESS).select("user_id", "event_id", "at", F.to_date("at").alias("day"))
    return days.groupBy("user_id", "day").applyInPandasWithState(count, "user_id long, event_id long, admitted boolean", "used long", "append", GroupStateTimeout.EventTimeTimeout)
