"""Timestamps as epoch milliseconds, UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: Date, T or space, time, fraction, zone. Other texts are no timestamps; a plain cast would take "10:00" for today.
ISO = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"

#: The end of such a text without a zone.
TAIL = r"(:\d\d:\d\d(?:\.\d+)?)$"


def parse_ms(c: Column) -> Column:
    """Milliseconds of an ISO-like text, or null. Without a zone it is UTC; digits beyond milliseconds are cut off."""
    return trimmed_ms(trim(c))


def trimmed_ms(t: Column) -> Column:
    """parse_ms() of a text that is trimmed already; t stands here once, as a filter on the result is pushed down to the cells."""
    zoned = F.regexp_replace(F.regexp_extract(t, ISO, 0), TAIL, "$1Z")
    return F.unix_millis(zoned.try_cast("timestamp"))


def iso(ms: Column) -> Column:
    """UTC text with three decimals and Z."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bucket_seconds(span_minutes: Column) -> Column:
    """A minute for spans of up to three hours, else a quarter of an hour."""
    return F.when(span_minutes <= 180, 60).otherwise(900)


def bucket_ms(ms: Column, seconds: Column) -> Column:
    """Start of the epoch-aligned bucket that ms lies in."""
    width = seconds.cast("long") * 1000
    return ms - F.pmod(ms, width)


def day_of(ms: int) -> str:
    """The UTC day of a time, as a date's text."""
    return (datetime(1970, 1, 1) + timedelta(milliseconds=ms)).strftime("%Y-%m-%d")
