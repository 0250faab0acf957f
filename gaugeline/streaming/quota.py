"""Streaming forms: the rolling quota alert, first intents and publication counts. They take batch frames too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alerts(charges: DataFrame, *, window: str = "30 minutes", slide: str | None = "1 minute", at_least: int = 1500, late: str = "10 minutes") -> DataFrame:
    """Windows of charges (ts, units) whose sum reaches the bar; a watermark bounds the state that a stream keeps."""
    timed = charges.withWatermark("ts", late) if charges.isStreaming else charges
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy(span).agg(F.sum("units").alias("units")).where(F.col("units") >= at_least)


def first_intents(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """E7 on a stream: one intent of each producer, artist and report among those that come within the watermark."""
    intents = events.where("event_type = 'intent_to_produce_declared'")
    key = ["producer_id", "artist_id", "report_id"]
    return intents.withWatermark("created_at", late).dropDuplicatesWithinWatermark(key) if intents.isStreaming else intents.dropDuplicates(key)


def publications(videos: DataFrame, *, days: int = 7, late: str = "1 day") -> DataFrame:
    """A9 on a stream: videos of each artist in windows of days that share no instant."""
    timed = videos.withWatermark("published_at", late) if videos.isStreaming else videos
    return timed.groupBy(F.window("published_at", f"{days} days"), "artist_id").agg(F.count("*").alias("n"))
