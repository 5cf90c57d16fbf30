"""Scan statistics by event-time window over a stream of documents or events: an extension, the batch operators have no windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and their sum of value by window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), key, "n", "value")
