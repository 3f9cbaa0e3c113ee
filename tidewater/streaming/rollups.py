"""Windowed rollups of event streams with late data (beyond parity: an extra)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum per window and event type of a stream or a table.

    events: ts, event_type, value. In a stream rows later than `late` behind the
    newest are dropped and a window is final once the watermark has passed it. Rows
    without a time are in no window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "event_type")
    sums = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
