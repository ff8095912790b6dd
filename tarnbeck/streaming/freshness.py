"""Streaming forms: event counts in windows with late data, and the newest stamp of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, event_type, n, total of tumbling windows; events later than `late` are not counted."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def newest(events: DataFrame, key: str) -> DataFrame:
    """key, fetched: the newest stamp so far, for update mode."""
    return events.groupBy(key).agg(F.max("ts").alias("fetched"))
