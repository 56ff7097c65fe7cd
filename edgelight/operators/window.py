"""The trailing window that ends at the newest row of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.times import day_of
from .canonical import Logs


def anchor(logs: Logs, minutes: float) -> DataFrame:
    """One row: anchor_ms, start_ms and end_ms. No filter moves it, nor does the clock."""
    newest = logs.frame.agg(F.max("ts_ms").alias("anchor_ms"))
    return newest.select("anchor_ms", (F.col("anchor_ms") - F.lit(int(minutes * 60_000))).alias("start_ms"), F.col("anchor_ms").alias("end_ms"))


def in_window(logs: Logs, minutes: float, anchor_ms: int | None = None) -> Logs:
    """Rows whose time is in [anchor - minutes, anchor], both ends included; rows without a time are out.

    With anchor_ms the bounds are literals, which reach the scan of a table that has ts_ms; of rows stored by day only the days of the window are read. Without, the start is a scalar subquery that reads
    nothing but the times; it is a filter like any other, so that of rows outside the window no other cell is parsed.
    """
    if anchor_ms is not None:
        start_ms = anchor_ms - int(minutes * 60_000)
        frame = logs.frame.where(F.col(logs.day).between(day_of(start_ms), day_of(anchor_ms))) if logs.day else logs.frame
        return logs.with_frame(frame.where(F.col("ts_ms").between(start_ms, anchor_ms)))
    return logs.with_frame(logs.frame.where(F.col("ts_ms") >= anchor(logs, minutes).select("start_ms").scalar()))


def span(logs: Logs) -> DataFrame:
    """One row: span_minutes between the oldest and the newest row, 1 at least, and the bucket_seconds that go with it."""
    minutes = (F.max("ts_ms") - F.min("ts_ms")) / F.lit(60000).cast("double")
    spans = logs.frame.agg(F.greatest(F.lit(1.0), F.coalesce(minutes, F.lit(0.0))).alias("span_minutes"))
    return spans.withColumn("bucket_seconds", times.bucket_seconds(F.col("span_minutes")).cast("long"))
