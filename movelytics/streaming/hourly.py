"""Hourly weather and movement counts over a stream, with late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """(key, hour, n) for finished hours of a stream or a table: the batch roll-up's counts, kept up to date."""
    win = F.window(F.col(time), "1 hour")
    return stream.withWatermark(time, late).groupBy(win, F.col(key)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("hour"), "n")
