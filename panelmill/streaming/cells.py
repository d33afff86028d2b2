"""Incremental panel cells over an event stream: an addition, for feeds that arrive in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_cells(events: DataFrame) -> DataFrame:
    """Events by type and day."""
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def streaming_cells(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The same over a stream with event-time watermark; a day closes once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return out.select("event_type", F.to_date("window.start").alias("day"), "n")
