"""Sliding event rates over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blackbar.operators.requests import event_rate


def event_rate_stream(
    events: DataFrame,
    ts: str,
    window: str = "1 minute",
    slide: str = "5 seconds",
    by: list[str] | None = None,
    late: str = "1 minute",
) -> DataFrame:
    """``event_rate`` of a streaming table; windows close ``late`` after their end."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return event_rate(timed, ts, window, slide, by)
