"""Order, lateness and telemetry of the tape; each function works on a batch and on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_metrics(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Event count and worst receipt lag per tumbling interval and session."""
    rows = events.withWatermark("received_at", watermark) if watermark else events
    return rows.groupBy(F.window("received_at", width), "session_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("receipt_lag_ms").alias("max_lag_ms"))


def dedupe(events: DataFrame, watermark: str) -> DataFrame:
    """Drop repeated deliveries of one stable event id inside the watermark."""
    return events.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["stable_event_id"])
