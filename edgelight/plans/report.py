"""Text and JSON of a triage, put together in the plan from aggregated figures."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import finite, number_text, read_number
from ..operators import metrics, quality
from ..operators.canonical import NUMERIC, SAMPLE
from ..operators.facts import top
from ..operators.filters import Filter, plain

if TYPE_CHECKING:
    from .triage import Triage

TITLE = "🧭 *CDN TRIAGE SUMMARY*"
STATUSES_IN_TEXT = 12


@dataclass(frozen=True)
class Report:
    summary: str
    metrics: dict[str, Any]

    def response(self) -> dict[str, Any]:
        return {"ok": True, "summaryText": self.summary, "metricsJson": self.metrics}


def failure(error: Exception) -> dict[str, Any]:
    return {"ok": False, "error": str(error) or "Unknown error"}


def iso(ms: int | float | None) -> str | None:
    if ms is None:
        return None
    t = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=int(ms))
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def _read(value: Any) -> float | None:
    return None if value is None else read_number(value)


def _or_zero(value: Any) -> float:
    x = read_number(value)
    return 0.0 if math.isnan(x) else x


def figures(found: dict[str, Any] | None) -> dict[str, float | None] | None:
    """The key figures of a report's JSON as numbers, as a reader that trusts no type takes them: what is missing is none, but requests are 0."""
    if not found:
        return None
    return {"totalRequests": _or_zero(found.get("totalRequests")), **{n: _read(found.get(n)) for n in ("p95TtmsMs", "p99TtmsMs", "error5xxCount", "errorRatePct")}}


def series(found: dict[str, Any] | None) -> dict[str, Any] | None:
    """The series of a report's JSON in the same way; points without a time are left out."""
    read = (found or {}).get("timeseries")
    if not read:
        return None
    points = read.get("points")
    counts, latencies = ("totalRequests", "error5xxCount", "errorRatePct"), ("p95TtmsMs", "p99TtmsMs")
    return {
        "bucketSeconds": _read(read.get("bucketSeconds")),
        **{n: str(read[n]) if read.get(n) else None for n in ("startTs", "endTs")},
        "points": [
            {"ts": str(p["ts"]), **{n: _or_zero(p.get(n)) for n in counts}, **{n: _read(p.get(n)) for n in latencies}}
            for p in (points if isinstance(points, list) else [])
            if p.get("ts")
        ],
    }


def filters_text(filters: tuple[Any, ...]) -> str:
    parts = []
    for item in filters:
        f = Filter.of(item)
        key = "undefined" if f.key is None else plain(f.key)
        if f.type == "range":
            parts.append(f"{key}={'undefined' if f.min is None else plain(f.min)}-{'undefined' if f.max is None else plain(f.max)}")
        elif f.type == "eq":
            parts.append(f"{key}={plain(f.value)}")
        elif f.type == "in":
            parts.append(f"{key} in ({','.join(plain(v) for v in f.values or ())})")
        else:
            parts.append("filter" if f.key is None else key)
    return ", ".join(parts) or "none"


def values_text(top: Column) -> Column:
    """value (count), ..., or n/a for none."""
    return F.when(F.size(top) > 0, F.array_join(F.transform(top, lambda s: F.concat(s["value"], F.lit(" ("), s["count"], F.lit(")"))), ", ")).otherwise("n/a")


def fixed_text(x: Column) -> Column:
    """Two decimals of the exact binary value of a number from 0 to 1e6, ties away from zero.

    Whether 200 x reaches an odd number is asked of the upper and the lower bits of x apart, whose products with 200 are exact.
    """
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    down = F.floor(x * 100)
    up = (high * 200 - (down * 2 + 1)) + (x - high) * 200 >= 0
    cents = (down + F.when(up, 1).otherwise(0)).cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


def pct_text(x: Column) -> Column:
    return F.when(finite(x), F.concat(fixed_text(x), F.lit("%"))).otherwise("n/a")


def ms_text(x: Column) -> Column:
    return F.when(finite(x), F.concat(F.floor(x + 0.5).cast("string"), F.lit(" ms"))).otherwise("n/a")


def json_number(x: Column) -> Column:
    """A JSON number: whole ones without a fraction, null for none or one that is not finite."""
    return F.when(finite(x), F.parse_json(number_text(x)))


def _joined(*lines: Column | str | None) -> Column:
    """Lines that are there, one below the other; columns may be null or arrays."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines if x is not None])


def _debug(t: Triage, whole: Row, dq: Column, warnings: Column, start: str | None, end: str | None) -> tuple[Column, Column]:
    """Text and JSON of what debugging shows; the row has sample, the first row that matches or else the first of the window."""
    available = {c: values_text(top(f"seen.{c}")) for c in ("service", "region", "pop", "crc_class", "crc", "edge_status")}

    def cell(name: str) -> Column:
        """A cell as it was read: blank numbers are empty text, what the table has no column for is left out."""
        value = F.col("sample")[name]
        if name not in NUMERIC:
            return value
        blank = F.parse_json(F.lit('""')) if name in t.logs.present else F.lit(None)
        return F.when(value.isNull(), blank).otherwise(json_number(value))

    sample = F.when(F.col("sample").isNotNull(), F.to_json(F.struct(*[cell(n).alias(n) for n in SAMPLE]), {"ignoreNullFields": "true"}))
    counts = {"rows_total": F.lit(whole["rows"]), "rows_inWindow": F.col("seen"), "rows_filtered": F.col("total")}
    times = {"anchor": end, "start": start, "end": end}
    lines = [
        F.lit("--- DEBUG ---"),
        *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in counts.items()],
        *[F.lit(f"{k}={v}") for k, v in times.items()],
        *[F.concat(F.lit(f"avail_{k}="), v) for k, v in available.items()],
        F.concat(F.lit("data_quality="), F.to_json(dq)),
        F.concat(F.lit("warnings="), F.when(F.size(warnings) > 0, F.array_join(warnings, " | ")).otherwise("none")),
        F.concat(F.lit("sample="), F.coalesce(sample, F.lit("n/a"))),
    ]
    as_json = F.struct(
        *[v.alias(k) for k, v in counts.items()],
        F.struct(*[F.lit(v).alias(k) for k, v in times.items()]).alias("time"),
        F.struct(*[v.alias(k) for k, v in available.items()]).alias("available"),
        dq.alias("data_quality"),
        warnings.alias("warnings"),
        F.parse_json(sample).alias("sample"),
    )
    return _joined(F.lit(""), F.lit("```"), *lines, F.lit("```")), as_json


def report_frame(t: Triage, whole: Row) -> DataFrame:
    """One row, summary and metrics: text and JSON of a triage, put together in the plan. whole: counters and bounds over all rows, as literals."""
    r, legacy = t.request, t.legacy
    facts = t.gathered()
    if r.debug:
        first = metrics.first_row(t.filtered, t.windowed, SAMPLE)
        facts = facts.join(F.broadcast(first.select(F.struct(*SAMPLE).alias("sample"))), how="left")
    start, end = iso(whole["start_ms"]), iso(whole["end_ms"])
    seen, total, errors, codes, points = (F.col(c) for c in ("seen", "total", "errors", "codes", "points"))
    window_counts = {"invalid_ts": F.lit(0).cast("long"), **{c: F.col(c) for c in quality.COUNTERS[1:]}}
    dq = F.struct(F.struct(*[F.lit(whole[c]).alias(c) for c in quality.COUNTERS]).alias("all"), F.struct(*[v.alias(c) for c, v in window_counts.items()]).alias("window"))
    warnings = quality.warning_texts(seen, total, window_counts, r.service, r.region, r.pop)
    hit, miss, bad_share = (metrics.percent(F.col(c), total) for c in ("hits", "misses", "errors"))
    p95, p99 = (F.get("p", F.lit(i)) for i in (0, 1))
    block, debug = _debug(t, whole, dq, warnings, start, end) if r.debug else (None, F.lit(None).cast("string"))
    minutes, filters = plain(float(r.window_minutes)), filters_text(r.filters)
    warned = F.when(F.size(warnings) > 0, F.concat(F.lit("⚠️ *Warnings*\n• "), F.array_join(warnings, "\n• ")))
    warned_below = F.when(F.size(warnings) > 0, _joined("", warned))

    # The sentences below are what readers of these reports know.
    scope = f"• Scope: service=`{r.service}`  region=`{r.region}`  pop=`{r.pop}`"
    empty = _joined(TITLE, "No data found in requested time window.", scope, f"• Window: `{minutes}m`  • Filters: `{filters}`", f"• Time (UTC): `{start}` → `{end}`", warned_below, block)
    there = [F.concat(F.lit(f"   - {c}: "), values_text(F.slice(top(f"seen.{c}"), 1, 6))) for c in ("service", "region", "pop", "crc_class", "edge_status")]
    asked = f"• Requested: service=`{r.service}` region=`{r.region}` pop=`{r.pop}` window=`{minutes}m`"
    no_match = _joined(TITLE, "No rows matched your filters.", asked, f"• Filters: `{filters}`", "• Available (this window):", *there, warned_below, block)
    names = {n: n.replace("_", " ") if n != "missing_edge_status" else "missing edge_status" for n in quality.COUNTERS[1:]}
    lacking = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.concat(F.lit(f"• {said}: "), F.col(n))) for n, said in names.items()]))
    worst = F.get(top("bad.crc"), F.lit(0))
    cache = F.concat(pct_text(hit), F.lit(" (miss "), pct_text(miss), F.lit(")"))
    code_lines = F.array_join(F.transform(F.slice(codes, 1, STATUSES_IN_TEXT), lambda c: F.concat(F.lit("• "), number_text(c["code"]), F.lit(": *"), c["count"], F.lit("*"))), "\n")
    full = _joined(
        TITLE,
        scope,
        f"• Window: `{minutes}m`  • Time (UTC): `{start}` → `{end}`",
        f"• Filters: `{filters}`",
        warned,
        F.when(F.size(lacking) > 0, F.concat(F.lit("⚠️ *Data Quality (window)*\n"), F.array_join(lacking, "\n"))),
        "📊 *Traffic & Performance*",
        F.concat(F.lit("• Requests: *"), total, F.lit("*")),
        F.concat(F.lit("• P95 TTMS: *"), ms_text(p95), F.lit("*")),
        None if legacy else F.concat(F.lit("• P99 TTMS: *"), ms_text(p99), F.lit("*")),
        F.concat(F.lit("• Cache Hit: *"), pct_text(hit), F.lit("*  (miss "), pct_text(miss), F.lit(")")),
        "🧮 *Response Codes*",
        F.when(F.size(codes) > 0, code_lines).otherwise("n/a"),
        "🧩 *Top breakdowns*",
        *[F.concat(F.lit(f"• {c}: "), values_text(top(f"kept.{c}"))) for c in ("service", "region", "pop", "crc_class")],
        "🧾 *Evidence*",
        F.when(errors > 0, F.concat(F.lit("• Error responses are dominated by `"), worst["value"], F.lit("` ("), worst["count"], F.lit(" of "), errors, F.lit(")."))),
        F.when(errors > 0, F.concat(F.lit("• Error responses: "), errors, F.lit("/"), total, F.lit(" ("), pct_text(bad_share), F.lit(")."))).otherwise("• No 5xx responses observed."),
        F.concat(F.lit("• Cache hit ratio "), cache, F.lit(".")),
        F.concat(F.lit("• Latency p95/p99 TTMS = "), ms_text(p95), F.lit("/"), ms_text(p99), F.lit(".")),
        block,
    )
    summary = F.when(total > 0, full).when(seen > 0, no_match).otherwise(empty)

    def point(p: Column) -> Column:
        share = metrics.percent(p["errors_5xx"], p["total"])
        latencies = [json_number(F.get(p["p"], F.lit(i))).alias(n) for i, n in enumerate(("p95TtmsMs", "p99TtmsMs"))]
        return F.struct(times.iso(p["bucket_ms"]).alias("ts"), p["total"].alias("totalRequests"), p["errors_5xx"].alias("error5xxCount"), json_number(share).alias("errorRatePct"), *latencies)

    series = F.struct(
        F.col("bucket_seconds").alias("bucketSeconds"),
        times.iso(F.get(points, F.lit(0))["bucket_ms"]).alias("startTs"),
        times.iso(F.try_element_at(points, F.lit(-1))["bucket_ms"]).alias("endTs"),
        F.transform(points, point).alias("points"),
    )
    always = {"warnings": warnings, "dataQuality": dq, "debug": debug}
    ratios = {"p95TtmsMs": json_number(p95), "p99TtmsMs": json_number(p99), "cacheHitPct": json_number(hit), "cacheMissPct": json_number(miss)}
    code_list = F.transform(codes, lambda c: F.struct(json_number(c["code"]).alias("code"), c["count"].alias("count")))
    fields = {
        "timeRangeUTC": F.struct(F.lit(start).alias("start"), F.lit(end).alias("end")),
        "totalRequests": total,
        **ratios,
        "statusCounts": code_list,
        "error5xxCount": errors,
        "errorRatePct": json_number(bad_share),
        "topCrcClass": F.transform(top("kept.crc_class"), lambda s: F.struct(s["value"].alias("crc_class"), s["count"].alias("count"))),
        "topErrorCrc": F.transform(top("bad.crc"), lambda s: F.struct(s["value"].alias("crc"), s["count"].alias("count"))),
        "timeseries": series,
        **always,
    }
    only_full = ("error5xxCount", "errorRatePct", "topCrcClass", "topErrorCrc")
    late = {"p99TtmsMs", "error5xxCount", "errorRatePct", "timeseries"}  # the oldest report knew neither p99 nor a series, and errors only in its text

    def packed(names) -> Column:
        return F.to_json(F.struct(*[fields[n].alias(n) for n in names]), {"ignoreNullFields": "false"})

    found = packed([n for n in fields if not (legacy and n in late)])
    nothing = packed([n for n in fields if n not in only_full])
    return facts.select(summary.alias("summary"), F.when(total > 0, found).otherwise(nothing).alias("metrics"))


def build(t: Triage, whole: Row) -> Report:
    """The report of a triage whose anchor is known."""
    row = report_frame(t, whole).first()
    return Report(row["summary"], json.loads(row["metrics"]))
