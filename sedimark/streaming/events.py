"""Windows, sessions and deduplication over event streams. Each function takes a stream or a
batch; on a stream a watermark bounds the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """ts as a timestamp with a watermark (a timestamp without time zone can't have one)."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if events.isStreaming else df


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, value."""
    w = F.window("ts", width)
    g = timed(events).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "value"
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, n: events of a user no further apart than the gap."""
    g = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, *keys: str) -> DataFrame:
    df = timed(events)
    return df.dropDuplicatesWithinWatermark([*keys]) if events.isStreaming else df.dropDuplicates([*keys])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Drives a stream through all that is available into a memory table."""
    q = (
        stream.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.table(name)
