"""Run events as a stream: an extension over the batch reports, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_progress(events: DataFrame, time: str = "ts", stage: str = "event_type", value: str = "value", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each stage in windows of event time; events later than `late` are left out.

    Works on a stream (state is dropped behind the watermark) and on a table alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = rows.groupBy(F.window(time, window), stage).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), stage, "n", "total")


def sessions(events: DataFrame, key: str, time: str = "ts", late: str = "2 hours", gap: str = "30 minutes") -> DataFrame:
    """One row for each session of a key (events at most `gap` apart): its start, its last event's time and its count."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return agg.select(key, F.col("session_window.start").alias("start"), "last", "n")
