"""From raw cells to canonical log rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edge, text, times

STATUS_COLUMNS = ["edge_status", "status", "http_status", "response_code"]
LATENCY_COLUMNS = ["ttms_ms", "ttms", "time_to_first_byte"]
NUMERIC = ["edge_status", "mid_status", "ttms_ms", "upstream_bytes", "edge_cache_hit"]
DIMENSIONS = ["service", "region", "pop", "crc", "crc_class"]
SAMPLE = ["ts", "service", "region", "pop", "crc", "crc_class", "edge_status", "ttms_ms", "url"]


@dataclass(frozen=True)
class Raw:
    """A raw table: cells are strings, columns maps header names to columns, row_id follows the order of input."""

    frame: DataFrame
    columns: dict[str, str]

    def cell(self, header: str) -> Column:
        return F.col(self.columns[header]) if header in self.columns else F.lit(None).cast("string")


@dataclass(frozen=True)
class Logs:
    """Canonical rows. Numbers are null where the cell is blank or absent and NaN where it is not a number.

    present: canonical numeric columns that exist as such in the table, so that their blanks count as 0 in sums and ranges.
    others: header names of further columns, reachable by filters.
    day: the column by which stored rows are partitioned (UTC dates as text), if they are.
    """

    frame: DataFrame
    present: frozenset[str]
    others: dict[str, str]
    day: str | None = None

    def value(self, name: str) -> Column:
        """A numeric column as metrics see it: a blank counts as 0 where the column exists, and not at all where not."""
        return F.coalesce(F.col(name), F.lit(0.0)) if name in self.present else F.col(name)

    def with_frame(self, frame: DataFrame) -> Logs:
        return Logs(frame, self.present, self.others, self.day)


def canonicalize(raw: Raw, legacy: bool = False) -> Logs:
    """Canonical rows of a raw table.

    Service, region and point of presence come from one column, chosen by which columns exist: a blank cell there is
    `unknown`, other columns are not asked. Status and latency take the first filled cell of several columns, row by row.
    legacy: the oldest rules, without aliases, by which each existing numeric cell is a number, a blank one 0.
    """
    named = raw.columns
    service = raw.cell("delivery_service") if "delivery_service" in named else raw.cell("service")
    region = raw.cell("region") if "region" in named else edge.region_of(raw.cell("url"))
    pop = raw.cell("pop") if "pop" in named else edge.pop_of(raw.cell("url"))

    def numeric(headers: list[str]) -> Column:
        """The trimmed cell that becomes the number, null for none."""
        cells = [text.trim(raw.cell(h)) for h in headers if h in named]
        if legacy or not cells:
            return cells[0] if cells else F.lit(None).cast("string")
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cells])

    aliases = {"edge_status": STATUS_COLUMNS, "ttms_ms": LATENCY_COLUMNS}
    taken = {"ts", "url", *DIMENSIONS, *NUMERIC}
    others = {h: f"cell_{i}" for i, h in enumerate(named) if h not in taken}
    # Cells first, what is made of them after: each is trimmed and chosen once.
    cells = raw.frame.select(
        F.col("row_id"),
        raw.cell("ts").alias("ts"),
        text.trim(raw.cell("ts")).alias("ts_text"),
        text.lower(service).alias("service"),
        text.lower(region).alias("region"),
        text.lower(pop).alias("pop"),
        text.upper(raw.cell("crc")).alias("crc"),
        *[numeric([n] if legacy else aliases.get(n, [n])).alias(n) for n in NUMERIC],
        raw.cell("url").alias("url"),
        *[raw.cell(h).alias(c) for h, c in others.items()],
    )
    frame = cells.select(
        "row_id",
        "ts",
        times.trimmed_ms(F.col("ts_text")).alias("ts_ms"),
        *[F.when(F.col(c) == "", "unknown").otherwise(F.col(c)).alias(c) for c in ("service", "region", "pop")],
        F.when(F.col("crc") == "", "UNKNOWN").otherwise(F.col("crc")).alias("crc"),
        edge.crc_class(F.col("crc")).alias("crc_class"),
        *[F.when(F.col(n).isNotNull(), text.trimmed_number(F.col(n))).alias(n) for n in NUMERIC],
        "url",
        *others.values(),
    )
    return Logs(frame, frozenset(n for n in NUMERIC if n in named), others)


def normalized(raw: Raw) -> DataFrame:
    """A short row of seven columns with other precedences: ts or timestamp, status before edge_status, no case folding."""

    def given(*headers: str) -> Column:
        return F.coalesce(*[raw.cell(h) for h in headers])

    def numeric(*headers: str) -> Column:
        return F.when(given(*headers).isNotNull(), text.number(given(*headers)))

    stamp = F.coalesce(F.nullif(raw.cell("ts"), F.lit("")), raw.cell("timestamp"))
    return raw.frame.select(
        "row_id",
        times.parse_ms(stamp).alias("ts"),
        F.coalesce(given("service"), F.lit("unknown")).alias("service"),
        F.coalesce(given("region"), F.lit("unknown")).alias("region"),
        F.coalesce(given("pop"), F.lit("unknown")).alias("pop"),
        numeric("status", "edge_status").alias("status"),
        numeric("ttms", "time_to_first_byte").alias("ttms"),
        F.coalesce(given("crc", "error_reason"), F.lit("other")).alias("crc"),
    )
