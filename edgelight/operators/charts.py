"""What charts of the series need: the last points, their range, bar heights and labels."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS, LEAST_HEIGHT = 48, 6.0
#: Metric names of a chart and their labels.
LABELS = {"errorRatePct": "5xx%", "totalRequests": "Requests", "error5xxCount": "5xx Count", "p95TtmsMs": "p95 TTMS (ms)", "p99TtmsMs": "p99 TTMS (ms)"}
COLUMNS = {"errorRatePct": "error_pct", "totalRequests": "total", "error5xxCount": "errors_5xx", "p95TtmsMs": "p95_ms", "p99TtmsMs": "p99_ms"}


def last_points(series: DataFrame, points: int = POINTS) -> DataFrame:
    return series.orderBy(F.desc("bucket_ms")).limit(points).orderBy("bucket_ms")


def value_range(series: DataFrame, metric: str, points: int = POINTS) -> DataFrame:
    """One row: low, high and latest of a metric over the last points; nulls are skipped, low is 0 and high 1 without any."""
    column = COLUMNS[metric]
    rows = last_points(series, points).select("bucket_ms", F.col(column).cast("double").alias("v"))
    known = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max_by("v", "bucket_ms").alias("latest"))
    return known.select(F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"), "latest")


def heights(series: DataFrame, metric: str, points: int = POINTS) -> DataFrame:
    """(bucket_ms, height): a bar's share of the range in per cent, LEAST_HEIGHT at least; null stays null."""
    rows = last_points(series, points).select("bucket_ms", F.col(COLUMNS[metric]).cast("double").alias("v"))
    limits = value_range(series, metric, points)
    spread = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("low")) / spread))
    return rows.join(F.broadcast(limits)).select("bucket_ms", F.when(F.col("v").isNotNull(), F.greatest(F.lit(LEAST_HEIGHT), share * 100)).alias("height")).orderBy("bucket_ms")


def half_up(x: float) -> int:
    """The nearest whole number, halves towards plus infinity."""
    return math.floor(x + 0.5)


def fixed(x: float, digits: int = 2) -> str:
    """Decimals of the exact binary value, ties away from zero."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def label(metric: str, value: float | None) -> str:
    if value is None or not math.isfinite(value):
        return "n/a"
    if metric == "errorRatePct":
        return f"{fixed(value)}%"
    if metric in ("p95TtmsMs", "p99TtmsMs"):
        return f"{half_up(value)} ms"
    return f"{half_up(value):,}"
