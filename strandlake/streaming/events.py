"""Streams of events: the counterparts of depth, coalesced runs and duplicate removal, with event time in the place of positions.

Every function takes a streaming or a batch DataFrame with ts (timestamp) and gives the same rows for both, as long as no event is
later than the watermark; later ones are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with ts as a timestamp (of the session's time zone where it has none) and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total: events in tumbling windows, or sliding ones where slide is given."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = _timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n: runs of a user's events with less than gap between neighbours."""
    rows = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first event met of each key; of a stream, state older than the watermark is forgotten."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
