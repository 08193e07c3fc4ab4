"""Streaming forms of history operators, an extension: windows, sessions, duplicates, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.sources.writers import append_status


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "7 days", step: str = "1 day") -> DataFrame:
    """Events per type in sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user's events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def without_repeats(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_log(events: DataFrame, path: str, checkpoint: str):
    """Write (name, status, completed_at) batches to a status log; see ``writers.current_status``."""
    return events.writeStream.foreachBatch(lambda batch, _: append_status(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
