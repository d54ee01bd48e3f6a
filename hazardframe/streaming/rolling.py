"""Structured Streaming forms of batch operators: windowed counts and exceedances with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total): counts and sums of ``value`` in tumbling or sliding windows; the same plan for batch and stream."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    held = events.withWatermark(ts, late) if events.isStreaming else events
    return held.groupBy(window, key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events of a key with gaps below ``gap``."""
    held = events.withWatermark(ts, late) if events.isStreaming else events
    return held.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
