"""Incremental counts over streams of events: an extension, with no counterpart among the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n and total value of an event stream by tumbling windows; rows later than the watermark are
    dropped and closed windows leave the state."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), key, "n", "total")


def running_demand(trips: DataFrame, time: str, late: str = "1 day", length: str = "1 day") -> DataFrame:
    """Demand by window and pair from a stream of trips (origin, destination, quantity)."""
    rows = trips.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "origin", "destination").agg(F.sum("quantity").alias("demand"))
    return rows.select(F.col("w.start").alias("window_start"), "origin", "destination", "demand")
