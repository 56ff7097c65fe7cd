"""Counts by dimension, status and minute in passes of grouping sets: what a report is made of, as one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .canonical import DIMENSIONS, Logs
from .metrics import SHARES, is_error, latency
from .selection import percentiles

#: Top values by rank: of all rows of the window (seen), of those that match (kept), and of the errors among these (bad).
LIMITS = {"seen": {**dict.fromkeys(DIMENSIONS, 8), "edge_status": 12}, "kept": dict.fromkeys(("service", "region", "pop", "crc_class"), 4), "bad": {"crc": 4}}

#: Values by dimension: counts and first rows add up map-side; each rank then takes its largest counts, ties by first appearance. The limit in front of
#: that of each field is a literal, so that a task passes on no more rows than that.
TOPS = """
WITH sets AS (
  SELECT CASE WHEN grouping(service) = 0 THEN 'service' WHEN grouping(region) = 0 THEN 'region' WHEN grouping(pop) = 0 THEN 'pop' WHEN grouping(crc) = 0 THEN 'crc'
      WHEN grouping(crc_class) = 0 THEN 'crc_class' ELSE 'edge_status' END AS field, coalesce(service, region, pop, crc, crc_class, status) AS value,
    count(*) AS seen, min(row_id) AS seen_first, count_if(kept) AS kept, min(kept_id) AS kept_first, count_if(bad) AS bad, min(bad_id) AS bad_first
  FROM {{rows}} GROUP BY GROUPING SETS ((service), (region), (pop), (crc), (crc_class), (status))
), ranked AS (
  SELECT field, value, r.* FROM sets LATERAL VIEW inline(array(
    struct('seen' AS rank, seen AS count, seen_first AS first), struct('kept' AS rank, kept AS count, kept_first AS first), struct('bad' AS rank, bad AS count, bad_first AS first))) r
  WHERE value <> ''
), limited AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank, field ORDER BY count DESC, first) AS place FROM ranked WHERE count > 0) WHERE place <= {most}
), listed AS (
  SELECT concat(rank, '.', field) AS name, array_sort(collect_list(struct(place, value, count))) AS top FROM limited WHERE place <= map({limits})[concat(rank, '.', field)] GROUP BY rank, field
)
SELECT map_from_entries(collect_list(struct(name, top))) AS tops FROM listed
"""

#: Figures of the window and of what matches, by status and minute, and the series in buckets of a width that follows the span.
FIGURES = """
WITH sets AS (
  SELECT grouping_id() AS id, code, minute, count(*) AS seen, count_if(NOT known) AS missing_edge_status, count_if(service = 'unknown') AS unknown_service, count_if(crc = 'UNKNOWN') AS unknown_crc,
    count_if(region = 'unknown') AS unknown_region, count_if(pop = 'unknown') AS unknown_pop, count_if(kept) AS total, count_if(kept AND hit) AS hits, count_if(kept AND miss) AS misses,
    count_if(bad) AS errors, count_if(kept AND five) AS errors_5xx, min(kept_ms) AS oldest, max(kept_ms) AS newest
  FROM {rows} GROUP BY GROUPING SETS ((code), (minute), ())
), spans AS (
  SELECT *, CASE WHEN (max(newest) OVER () - min(oldest) OVER ()) / 60000.0D <= 180 THEN 60 ELSE 900 END AS width FROM sets
), buckets AS (
  SELECT minute - pmod(minute, width * 1000) AS bucket_ms, any_value(width) AS width, sum(total) AS total, sum(errors_5xx) AS errors_5xx FROM spans WHERE id = 2 AND total > 0 GROUP BY 1
), points AS (
  SELECT b.*, p.p FROM buckets b LEFT JOIN {latencies} p ON b.bucket_ms = p.bucket_ms
), series AS (
  SELECT array_sort(collect_list(struct(bucket_ms, total, errors_5xx, p))) AS points, any_value(width) AS bucket_seconds FROM points
), codes AS (
  SELECT array_sort(collect_list(struct(code, total AS count))) AS codes FROM sets WHERE id = 1 AND code IS NOT NULL AND total > 0
), sums AS (
  SELECT seen, missing_edge_status, unknown_service, unknown_crc, unknown_region, unknown_pop, total, hits, misses, errors FROM sets WHERE id = 3
), overall AS (
  SELECT any_value(p) AS p FROM {latencies} WHERE bucket_ms IS NULL
), filled AS (
  SELECT coalesce(sum(seen), 0) AS seen, coalesce(sum(missing_edge_status), 0) AS missing_edge_status, coalesce(sum(unknown_service), 0) AS unknown_service, coalesce(sum(unknown_crc), 0) AS unknown_crc,
    coalesce(sum(unknown_region), 0) AS unknown_region, coalesce(sum(unknown_pop), 0) AS unknown_pop, coalesce(sum(total), 0) AS total, coalesce(sum(hits), 0) AS hits,
    coalesce(sum(misses), 0) AS misses, coalesce(sum(errors), 0) AS errors FROM sums
)
SELECT f.*, s.points, s.bucket_seconds, c.codes, o.p, t.tops
FROM filled f LEFT JOIN series s ON true LEFT JOIN codes c ON true LEFT JOIN overall o ON true LEFT JOIN {tops} t ON true
"""


def gathered(windowed: Logs, kept: Column, few_buckets: bool = False) -> DataFrame:
    """One row with all counts of a report: seen, the quality counters of the window, total, hits, misses and errors of the rows that match, p (their
    percentiles), tops (a map from rank.field to place, value and count, as LIMITS say), codes (code, count) and points (bucket_ms, total, errors_5xx, p).

    kept: whether a row of the window matches. One pass goes over dimensions, one over statuses and minutes, one over latencies, each with only the
    columns it needs; their sums are added up map-side and meet as one row, bounded by the limits, the statuses and the buckets of the window.
    """
    cache, status = windowed.value("edge_cache_hit"), F.col("edge_status")
    kept = F.coalesce(kept, F.lit(False))
    rows = windowed.frame.select(
        "row_id", "ts_ms", *DIMENSIONS, status, kept.alias("kept"), latency(windowed).alias("latency"), (cache == 1).alias("hit"), (cache == 0).alias("miss"), F.coalesce(is_error(status), F.lit(False)).alias("err"),
    )
    rows = rows.select(
        "*",
        text.trim(text.number_text(status)).alias("status"),
        text.no_nan(status).alias("code"),
        text.finite(status).alias("known"),
        ((status >= 500) & (status < 600)).alias("five"),
        (F.col("ts_ms") - F.pmod("ts_ms", F.lit(60_000))).alias("minute"),
        (F.col("kept") & F.col("err")).alias("bad"),
        F.when(F.col("kept"), F.col("row_id")).alias("kept_id"),
        F.when(F.col("kept") & F.col("err"), F.col("row_id")).alias("bad_id"),
        F.when(F.col("kept"), F.col("ts_ms")).alias("kept_ms"),
    )
    spark = windowed.frame.sparkSession
    limits = ", ".join(f"'{rank}.{field}', {n}" for rank, fields in LIMITS.items() for field, n in fields.items())
    tops = spark.sql(TOPS.format(limits=limits, most=max(n for fields in LIMITS.values() for n in fields.values())), rows=rows)
    width = spark.sql("SELECT CASE WHEN (max(ts_ms) - min(ts_ms)) / 60000.0D <= 180 THEN 60000 ELSE 900000 END AS width FROM {rows} WHERE kept", rows=rows)
    # Each latency counts in its bucket and, with a null bucket, in all.
    each = rows.where("kept").select(F.explode(F.array(F.col("ts_ms") - F.pmod("ts_ms", width.scalar()), F.lit(None).cast("long"))).alias("bucket_ms"), "latency")
    latencies = percentiles(each, ["bucket_ms"], F.col("latency"), SHARES, few_buckets)
    return spark.sql(FIGURES, rows=rows, latencies=latencies, tops=tops)


def top(name: str) -> Column:
    """The top values under rank.field in the row of gathered(), none if there are none."""
    none = F.array().cast("array<struct<place: int, value: string, count: bigint>>")
    return F.coalesce(F.col("tops")[name], none)


__all__: Sequence[str] = ["LIMITS", "gathered", "top"]
