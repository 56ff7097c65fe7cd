"""Dimension matches and list, range and equality filters as predicates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from .canonical import DIMENSIONS, NUMERIC, Logs


@dataclass(frozen=True)
class Filter:
    key: str | None
    type: str | None
    min: Any = None
    max: Any = None
    value: Any = None
    values: tuple[Any, ...] | None = None

    @classmethod
    def of(cls, item: Any) -> Filter:
        if isinstance(item, Filter):
            return item
        if not isinstance(item, dict):
            return cls(None, None)
        values = item.get("values")
        return cls(item.get("key"), item.get("type"), item.get("min"), item.get("max"), item.get("value"), tuple(values) if isinstance(values, list | tuple) else None)


def plain(value: Any) -> str:
    """A filter's value as text, numbers as the log's numbers are written."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "Infinity" if value > 0 else "-Infinity"
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    return str(value)


def number_equals(number: Column, wanted: str) -> Column:
    """Whether a number, written as the log's numbers are, reads as a lower-case text; blank and absent ones are empty.

    The text is read here, so rows compare numbers: 200 matches a raw 200.0, but no number is written 12.50.
    """
    if wanted == "":
        return number.isNull()
    if wanted == "nan":
        return F.isnan(number)
    try:
        value = float(wanted)
    except ValueError:
        return F.lit(False)
    return number == F.lit(value) if plain(value).lower() == wanted else F.lit(False)


def equals(logs: Logs, key: str, wanted: str) -> Column:
    wanted = wanted.strip().lower()
    if key in NUMERIC:
        return number_equals(F.col(key), wanted)
    return text.lower(F.coalesce(_cell(logs, key), F.lit(""))) == wanted


def as_number(logs: Logs, key: str) -> Column:
    """The value under a key as a number: blank 0, absent and other text NaN (null counts as NaN in comparisons)."""
    if key in NUMERIC:
        return logs.value(key)
    return text.number(_cell(logs, key))


def _cell(logs: Logs, key: str) -> Column:
    if key in DIMENSIONS or key in ("ts", "url"):
        return F.col(key)
    return F.col(logs.others[key]) if key in logs.others else F.lit(None).cast("string")


def predicate(logs: Logs, item: Any) -> Column | None:
    """The condition of one filter, or None if it lets all rows pass (no key, or no known type)."""
    f = Filter.of(item)
    if not f.key:
        return None
    if f.type == "range":
        value = as_number(logs, f.key)
        keep = text.finite(value)
        for limit, compare in ((f.min, lambda b: value >= b), (f.max, lambda b: value <= b)):
            if limit is not None:
                b = text.read_number(limit)
                keep &= F.lit(False) if math.isnan(b) else compare(F.lit(b))
        return keep
    if f.type == "eq":
        return equals(logs, f.key, plain(f.value))
    if f.type == "in":
        return reduce(lambda a, b: a | b, [equals(logs, f.key, plain(v)) for v in f.values or ()], F.lit(False))
    return None


def dimension(name: str, wanted: str | None) -> Column | None:
    """Equality without regard to case or outer white space; empty and exactly `all` let all rows pass."""
    if not wanted or wanted == "all":
        return None
    return F.col(name) == wanted.strip().lower()


def conditions(logs: Logs, service: str = "all", region: str = "all", pop: str = "all", filters=()) -> list[Column]:
    """What a row must meet, one condition for each dimension and filter that does not let all rows pass."""
    found = (dimension("service", service), dimension("region", region), dimension("pop", pop), *(predicate(logs, f) for f in filters))
    return [c for c in found if c is not None]


def restrict(logs: Logs, service: str = "all", region: str = "all", pop: str = "all", filters=()) -> Logs:
    """The rows that match all dimensions and filters."""
    return logs.with_frame(reduce(lambda frame, c: frame.where(c), conditions(logs, service, region, pop, filters), logs.frame))
