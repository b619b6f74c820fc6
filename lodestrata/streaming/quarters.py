"""Quarterly aggregates of a stream: the batch aggregation under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Count and sum per window and group; rows later than the watermark are dropped, as streaming state must end somewhere. Works on a batch DataFrame alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs an instant
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
