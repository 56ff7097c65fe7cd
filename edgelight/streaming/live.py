"""The time series over an unbounded stream of logs: an extension, with the figures of the batch series for each bucket that is closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.canonical import Logs
from ..operators.metrics import SHARES, latency, percent
from ..operators.selection import percentiles


def live_counts(logs: Logs, bucket: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(bucket_ms, value, total, errors_5xx) per fixed bucket and latency (null for none), final once the watermark has passed the bucket.

    The state is a row of counts for each bucket and latency, spread over all tasks, and goes when its bucket closes; all rows of a bucket come out in one batch.
    """
    rows = logs.frame.where("ts_ms is not null").withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", bucket), latency(logs).alias("value")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("edge_status") >= 500) & (F.col("edge_status") < 600)).alias("errors_5xx"),
    )
    return counts.select(F.unix_millis("window.start").alias("bucket_ms"), "value", "total", "errors_5xx")


def closed_series(counts: DataFrame) -> DataFrame:
    """(bucket_ms, total, errors_5xx, error_pct, p95_ms, p99_ms) of closed buckets, as the batch series has them: percentiles are exact."""
    sums = counts.groupBy("bucket_ms").agg(F.sum("total").alias("total"), F.sum("errors_5xx").alias("errors_5xx"))
    both = sums.join(percentiles(counts, ["bucket_ms"], F.col("value"), SHARES, times=F.col("total")), "bucket_ms", "left")
    return both.select(
        "bucket_ms", "total", "errors_5xx", percent(F.col("errors_5xx"), F.col("total")).alias("error_pct"), F.get("p", F.lit(0)).alias("p95_ms"), F.get("p", F.lit(1)).alias("p99_ms"),
    )


def live_series(logs: Logs, sink: Callable[[DataFrame, int], None], bucket: str = "60 seconds", late: str = "10 minutes") -> DataStreamWriter:
    """A stream that hands the series of the buckets that close in a micro-batch to sink, with the number of the batch; options and start() are the caller's.

    A batch that is run again after a failure has the same number and the same rows, so that a sink can write it again in its place.
    """
    return live_counts(logs, bucket, late).writeStream.outputMode("append").foreachBatch(lambda counts, number: sink(closed_series(counts), number))
