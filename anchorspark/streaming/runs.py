"""Streams over append-only logs (an extension: event time, watermarks, sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(log: DataFrame, late: str) -> DataFrame:
    """The log with ts as an event time, whether or not it was stored with a zone."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_rates(log: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and passes per window and type of a log (ts, event_type, passed)."""
    return _timed(log, late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("passed").alias("passed")).select(F.col("window.start").alias("start"), "event_type", "n", "passed")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: start, end and events."""
    return _timed(log, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(log: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Events once each, however often they were sent within the watermark."""
    return _timed(log, late).dropDuplicatesWithinWatermark([key])
