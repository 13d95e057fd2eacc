"""Event-time windows over change and access streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "file") -> DataFrame:
    """(by, start, end, n) of sessions of activity; ``events`` has ts TIMESTAMP."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(by, start, n) of windows of equal size, overlapping if ``slide`` is smaller."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")
