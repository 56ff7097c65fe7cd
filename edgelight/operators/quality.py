"""Data quality counters and the warnings that follow from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .canonical import Logs

COUNTERS = ["invalid_ts", "missing_edge_status", "unknown_service", "unknown_crc", "unknown_region", "unknown_pop"]


def counters(logs: Logs, *more: Column) -> DataFrame:
    """One row: rows, more aggregates, and how many lack a valid time, a finite status, or a known service, code, region or point of presence."""
    return logs.frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("ts_ms").isNull()).alias("invalid_ts"),
        F.count_if(~text.finite(F.col("edge_status"))).alias("missing_edge_status"),
        F.count_if(F.col("service") == "unknown").alias("unknown_service"),
        F.count_if(F.col("crc") == "UNKNOWN").alias("unknown_crc"),
        F.count_if(F.col("region") == "unknown").alias("unknown_region"),
        F.count_if(F.col("pop") == "unknown").alias("unknown_pop"),
        *more,
    )


def warning_texts(windowed: Column, filtered: Column, window: dict[str, Column], service: str, region: str, pop: str) -> Column:
    """What to warn of, in order, as an array. A filter that lets all rows pass is suspect, but only the filters together are compared."""
    # The sentences of the warnings.
    idle = [
        (service, f"Service filter '{service}' did not reduce dataset (possible schema mismatch)."),
        (region, f"Region filter '{region}' did not reduce dataset."),
        (pop, f"POP filter '{pop}' did not reduce dataset."),
    ]
    missing, invalid = window["missing_edge_status"], window["invalid_ts"]
    said = [F.when((windowed > 0) & (filtered == windowed), F.lit(text)) for wanted, text in idle if wanted != "all"]
    said.append(F.when((windowed > 0) & (filtered == 0), F.lit("Filters removed all rows. Check available values in DEBUG.")))
    said.append(F.when(missing > 0, F.concat(F.lit("Some rows missing edge_status ("), missing, F.lit("). Response code totals may not sum perfectly."))))
    said.append(F.when(invalid > 0, F.concat(F.lit("Some rows have invalid ts in window ("), invalid, F.lit(")."))))
    return F.array_compact(F.array(*said))


def warning_counts(windowed: Logs, filtered: Logs) -> DataFrame:
    """One row with the counts that warnings compare: windowed, filtered, missing_edge_status and invalid_ts in the window."""
    w = counters(windowed).select(F.col("rows").alias("windowed"), "missing_edge_status", "invalid_ts")
    f = filtered.frame.agg(F.count(F.lit(1)).alias("filtered"))
    return w.join(F.broadcast(f)).select("windowed", "filtered", "missing_edge_status", "invalid_ts")
