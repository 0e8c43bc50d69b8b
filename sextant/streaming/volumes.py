"""Event volumes over streams: the batch panel's counts as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_volumes(stream: DataFrame, at: str, key: str, lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """Rows by window and key; rows later than the watermark are left out. Works on batches too."""
    w = stream.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions of a key: rows no further apart than the gap."""
    w = stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
