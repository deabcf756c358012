"""Notifications as a stream: the same transformations run on a batch and on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def subscribe(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events and their value by type and window; on a stream, rows later than ``late`` are left out.
    None: the stream has a watermark already."""
    at = events.withWatermark("ts", late) if events.isStreaming and late else events
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "event_type", "n"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between neighbours."""
    at = events.withWatermark("ts", late) if events.isStreaming and late else events
    return at.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").alias("start"), "n"
    )


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is delivered."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
