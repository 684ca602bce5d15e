"""Structured Streaming forms of operators that work on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """``events`` with ``ts`` as a point in time (UTC where it names no zone), as watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, beg, end, n: islands of events no farther apart than ``gap``, as they close.

    Rows later than ``late`` behind the newest event are dropped by the watermark, which also
    bounds the state.
    """
    s = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("end"))
    return s.select("user_id", F.col("w.start").alias("beg"), "end", "n")


def window_counts(events: DataFrame, size: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    """beg, event_type, n, total: sliding windows over event time."""
    s = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select(F.col("w.start").alias("beg"), "event_type", "n", "total")
