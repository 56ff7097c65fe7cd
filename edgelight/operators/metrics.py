"""Counts, ratios, percentiles, top values and the time series of a set of log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times
from .canonical import DIMENSIONS, Logs
from .selection import percentiles
from .window import span


def percent(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total * 100)


def latency(logs: Logs) -> Column:
    value = logs.value("ttms_ms")
    return F.when(text.finite(value), value)


SHARES = (0.95, 0.99)


def kpis(logs: Logs) -> DataFrame:
    """One row of key figures.

    Percentiles are exact, with linear interpolation. Errors are all statuses from 500 on, also above 599. Counters and latencies are read side by side.
    """
    cache, status = logs.value("edge_cache_hit"), F.col("edge_status")
    sums = logs.frame.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(cache == 1).alias("hit_count"),
        F.count_if(cache == 0).alias("miss_count"),
        F.count_if(is_error(status)).alias("error_count"),
        F.count_if(~text.finite(status)).alias("missing_edge_status"),
    )
    total = F.col("total")
    both = sums.join(F.broadcast(percentiles(logs.frame, [], latency(logs), SHARES)), how="left")  # a row each, or none of percentiles
    return both.select(
        "total",
        "hit_count",
        "miss_count",
        percent(F.col("hit_count"), total).alias("hit_pct"),
        percent(F.col("miss_count"), total).alias("miss_pct"),
        "error_count",
        percent(F.col("error_count"), total).alias("error_pct"),
        "missing_edge_status",
        F.get("p", F.lit(0)).alias("p95_ms"),
        F.get("p", F.lit(1)).alias("p99_ms"),
    )


def status_counts(logs: Logs) -> DataFrame:
    """(code, count) by code; blank and unparsable statuses are left out."""
    known = logs.frame.where(text.no_nan(F.col("edge_status")).isNotNull())
    return known.groupBy(F.col("edge_status").alias("code")).agg(F.count(F.lit(1)).alias("count")).orderBy("code")


def is_error(status: Column) -> Column:
    """Whether a status is a number from 500 on; null where there is none."""
    return text.no_nan(status) >= 500


def errors(logs: Logs) -> Logs:
    return logs.with_frame(logs.frame.where(is_error(F.col("edge_status"))))


def _value(column: str) -> Column:
    return text.trim(text.number_text(F.col(column)) if column == "edge_status" else F.col(column))


def top(logs: Logs, column: str, limit: int = 6) -> DataFrame:
    """(value, count, first_row): the most frequent values, ties by first appearance; blank ones are left out."""
    rows = logs.frame.select(_value(column).alias("value"), "row_id").where("value <> ''")
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"), F.min("row_id").alias("first_row"))
    return counts.orderBy(F.desc("count"), "first_row").limit(limit)


def top_of_each(logs: Logs, limits: dict[str, int]) -> DataFrame:
    """(field, place, value, count, first_row): top() of several columns in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), _value(c).alias("value")) for c in limits])
    rows = logs.frame.select("row_id", F.explode(pairs).alias("x")).select("x.field", "x.value", "row_id").where("value <> ''")
    counts = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"), F.min("row_id").alias("first_row"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "first_row"))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("field"))
    # The largest limit is a literal, so that each task passes on no more than that of a field.
    first = counts.withColumn("place", place).where(F.col("place") <= max(limits.values()))
    return first.where(F.col("place") <= limit).select("field", "place", "value", "count", "first_row").orderBy("field", "place")


def available_limits(limit: int, statuses: int) -> dict[str, int]:
    return {**dict.fromkeys(DIMENSIONS, limit), "edge_status": statuses}


def bucketed(logs: Logs, bucket_seconds: int | None = None) -> Logs:
    """The rows with a time, with the bucket_ms that they are in."""
    rows = logs.frame.where("ts_ms is not null")
    width = F.lit(bucket_seconds) if bucket_seconds else span(logs).select("bucket_seconds").scalar()
    return logs.with_frame(rows.withColumn("bucket_ms", times.bucket_ms(F.col("ts_ms"), width)))


def timeseries(logs: Logs, bucket_seconds: int | None = None, few_buckets: bool = False) -> DataFrame:
    """(bucket_ms, total, errors_5xx, error_pct, p95_ms, p99_ms) by time; buckets without rows are left out.

    The bucket's width follows the span of the rows themselves unless it is given. An error here is 500 to 599. few_buckets: a window bounds their
    number.
    """
    rows, status = bucketed(logs, bucket_seconds).frame, F.col("edge_status")
    sums = rows.groupBy("bucket_ms").agg(F.count(F.lit(1)).alias("total"), F.count_if((status >= 500) & (status < 600)).alias("errors_5xx"))
    both = sums.join(percentiles(rows, ["bucket_ms"], latency(logs), SHARES, few_buckets), "bucket_ms", "left")
    return both.select(
        "bucket_ms",
        "total",
        "errors_5xx",
        percent(F.col("errors_5xx"), F.col("total")).alias("error_pct"),
        F.get("p", F.lit(0)).alias("p95_ms"),
        F.get("p", F.lit(1)).alias("p99_ms"),
    ).orderBy("bucket_ms")


def envelope(logs: Logs) -> DataFrame:
    """One row: bucket_seconds, start_ms and end_ms of the series, points; all null and 0 without rows."""
    rows = logs.frame.where("ts_ms is not null").join(F.broadcast(span(logs).select("bucket_seconds")))
    bucket = times.bucket_ms(F.col("ts_ms"), F.col("bucket_seconds"))
    return rows.agg(F.max("bucket_seconds").alias("bucket_seconds"), F.min(bucket).alias("start_ms"), F.max(bucket).alias("end_ms"), F.count_distinct(bucket).alias("points"))


def first_row(filtered: Logs, windowed: Logs, columns: list[str]) -> DataFrame:
    """The first row in the order of input: of the filtered rows, or of the window if there are none."""
    def first(logs: Logs, rank: int) -> DataFrame:
        return logs.frame.agg(F.min_by(F.struct("row_id", *columns), "row_id").alias("row")).withColumn("rank", F.lit(rank))

    both = first(filtered, 0).unionByName(first(windowed, 1)).where("row is not null")
    return both.orderBy("rank").limit(1).select("row.*")
