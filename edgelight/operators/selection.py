"""Exact percentiles without a sort of all values: counts by value, by ranges of values, then only the ranges that hold the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of values for each factor of e in the first round, and parts of a range in the second.
FINENESS, PARTS = 1024, 65536

#: One statement, as it is analysed once; each of its tables but the last is a short step of the text below. The range of a value rises with it, and any
#: doubles have under 1.5 million of them; it is never null, so that no filter for nulls is added that would part equal exchanges.
SELECTION = """
WITH counted AS (
  SELECT {by} value, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS n FROM {{cells}} GROUP BY {by} value HAVING sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) > 0
), counts AS (
  SELECT {group} AS g, value, n, coalesce(CAST(signum(value) * floor(log1p(abs(value)) * {fineness}) AS BIGINT), 0) AS span FROM counted
), spans AS (
  SELECT g, span, sum(n) AS n, min(value) AS low, max(value) AS high FROM counts GROUP BY g, span
), upto_span AS (
  SELECT *, sum(n) OVER (PARTITION BY g) AS known, sum(n) OVER (PARTITION BY g ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM spans
), wanted_spans AS (
  SELECT g, span, low, high, known, upto - n AS before, explode(filter(array_distinct(array({ranks})), r -> r >= upto - n AND r < upto)) AS rank FROM upto_span
), inside AS (
  SELECT {hint_spans} c.g, w.known, w.rank, w.rank - w.before AS rest, CASE WHEN high > low THEN CAST(floor((value - low) / (high - low) * {parts}) AS INT) ELSE 0 END AS part, value, n
  FROM counts c JOIN wanted_spans w ON c.g = w.g AND c.span = w.span
), upto_part AS (
  SELECT *, sum(n) OVER (PARTITION BY g, rank ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM (SELECT g, known, rank, rest, part, sum(n) AS n FROM inside GROUP BY g, known, rank, rest, part)
), wanted_parts AS (
  SELECT g, known, rank, rest, part, rest - upto + n AS left FROM upto_part WHERE rest < upto AND rest >= upto - n
), upto_value AS (
  SELECT {hint_parts} i.*, w.left, sum(n) OVER (PARTITION BY i.g, i.rank ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM inside i JOIN wanted_parts w ON i.g = w.g AND i.known = w.known AND i.rank = w.rank AND i.rest = w.rest AND i.part = w.part
), found AS (
  SELECT g, max(known) AS known, map_from_entries(collect_list(struct(rank, value))) AS at FROM upto_value WHERE left < upto AND left >= upto - n GROUP BY g
)
SELECT {names} array({values}) AS p FROM found
"""


def percentiles(rows: DataFrame, groups: Sequence[str], value: Column, shares: Sequence[float], few_groups: bool = False, times: Column | None = None) -> DataFrame:
    """groups and p, an array with the exact percentile of each share (0 to 1) by linear interpolation.

    value: finite doubles; rows where it is null are left out, a null group is one like others. Groups without values have no row, and so a table without
    groups has one row or none.

    Rows are counted by group and value, map-side first, in one exchange that all that follows reads. Counts by ranges of values, which grow with the
    size of the value, show in which ranges the wanted ranks are; each such range is split into PARTS between its least and its largest value, and only the
    values of one part are put in order. So a group with very many rows is spread over all tasks, and none gathers more than the ranges of a group or
    the distinct values of a part. few_groups says that a few rows for each group (two for each share) are little enough to be sent to all tasks. times:
    how often a row's value counts, once if not given.
    """
    cells = rows.select(*groups, value.alias("value"), (F.lit(1) if times is None else times).cast("long").alias("n"))
    names = [f"`{g}`" for g in groups]
    few = few_groups or not groups

    def rank(share: float, whole: str = "") -> str:
        at = f"{share!r}D * (known - 1)"
        return f"CAST({whole}({at}) AS BIGINT)" if whole else f"({at})"

    def interpolated(share: float) -> str:
        low, high = (f"element_at(at, {rank(share, f)})" for f in ("floor", "ceil"))
        return f"{low} + ({high} - {low}) * ({rank(share)} - floor{rank(share)})"

    text = SELECTION.format(
        by="".join(f"{g}, " for g in names),
        group=f"struct({', '.join(names)})" if groups else "0",
        names="".join(f"g.{g} AS {g}, " for g in names),
        ranks=", ".join(rank(s, f) for s in shares for f in ("floor", "ceil")),
        values=", ".join(interpolated(s) for s in shares),
        hint_spans="/*+ BROADCAST(w) */" if few else "",
        hint_parts="/*+ BROADCAST(w) */" if few else "",
        fineness=FINENESS,
        parts=PARTS,
    )
    return rows.sparkSession.sql(text, cells=cells)
