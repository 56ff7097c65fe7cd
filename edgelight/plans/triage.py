"""The triage query: canonical rows, trailing window, filters, metrics, and the report of one request."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, quality, window
from ..operators.canonical import SAMPLE, Logs, Raw, canonicalize
from ..operators.facts import gathered
from ..operators.filters import conditions, restrict
from ..sources import store
from ..sources.csv import NO_ROWS, InputError
from .report import Report, build, report_frame
from .request import TriageRequest


#: Windows up to this length (ten years) have few enough buckets to send four rows for each to all tasks: 350,000 of a quarter of an hour.
MOST_MINUTES = 5_256_000


@dataclass
class Triage:
    """Lazy frames of one request. Nothing runs before a frame is used; report() runs two jobs, of an aggregate each."""

    raw: Raw
    request: TriageRequest = TriageRequest()
    legacy: bool = False
    #: The anchor, where it is known: window bounds are then literals.
    anchor_ms: int | None = None

    @cached_property
    def logs(self) -> Logs:
        return canonicalize(self.raw, self.legacy)

    @classmethod
    def stored(cls, logs: Logs, request: TriageRequest = TriageRequest()) -> Triage:
        """A triage of logs as store.read() gives them: the anchor comes from the newest day, and only the days of the window are read."""
        found = cls(Raw(logs.frame, {}), request, anchor_ms=store.newest_ms(logs))
        found.__dict__["logs"] = logs
        return found

    @cached_property
    def windowed(self) -> Logs:
        return window.in_window(self.logs, self.request.window_minutes, self.anchor_ms)

    @cached_property
    def filtered(self) -> Logs:
        r = self.request
        return restrict(self.windowed, r.service, r.region, r.pop, r.filters)

    def anchor(self) -> DataFrame:
        return window.anchor(self.logs, self.request.window_minutes)

    def kpis(self) -> DataFrame:
        return metrics.kpis(self.filtered)

    def timeseries(self) -> DataFrame:
        return metrics.timeseries(self.filtered, few_buckets=self.request.window_minutes <= MOST_MINUTES)

    def gathered(self) -> DataFrame:
        """All counts of a report as one row."""
        r = self.request
        kept = reduce(lambda a, b: a & b, conditions(self.windowed, r.service, r.region, r.pop, r.filters), F.lit(True))
        return gathered(self.windowed, kept, r.window_minutes <= MOST_MINUTES)

    def _whole(self) -> Row:
        """Counters, anchor and bounds over all rows."""
        minutes = self.request.window_minutes
        both = quality.counters(self.logs, F.max("ts_ms").alias("anchor_ms"))
        found = both.select("*", (F.col("anchor_ms") - int(minutes * 60_000)).alias("start_ms"), F.col("anchor_ms").alias("end_ms")).first()
        if not found["rows"]:
            raise InputError(NO_ROWS)
        if found["anchor_ms"] is None:
            raise InputError("No valid timestamps found. Check ts format (expected ISO-like).")
        return found

    def report_frame(self) -> DataFrame:
        """summary and metrics (JSON) as one row. The anchor is found first, so that the window has literal bounds; all else is one plan."""
        whole = self._whole()
        return report_frame(self._anchored(whole), whole)

    def _anchored(self, whole: Row) -> Triage:
        known = replace(self, anchor_ms=whole["anchor_ms"])
        known.__dict__["logs"] = self.logs
        return known

    def report(self) -> Report:
        """Text and JSON, in two steps: counters and anchor of all rows, then the report itself, of which one row reaches the driver."""
        whole = self._whole()
        return build(self._anchored(whole), whole)


def run(spark: SparkSession, raw: Raw, request: TriageRequest, legacy: bool = False) -> Report:
    return Triage(raw, request, legacy).report()


__all__ = ["SAMPLE", "Triage", "run"]
