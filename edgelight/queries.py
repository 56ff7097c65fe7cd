"""The queries of the triage engine over the `events` test table, each with the SQL that says what it returns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, times
from .operators import charts, metrics, quality, window
from .operators.canonical import Raw, canonicalize
from .plans.request import TriageRequest
from .plans.triage import Triage
from .sources import store
from .sources.csv import read_csv
from .sources.events import raw_logs

DAY, MONTH = 1440, 43200
ERRORS_5XX = {"key": "edge_status", "type": "range", "min": 500, "max": 599}
NOT_FOUND = {"key": "edge_status", "type": "eq", "value": 404}
TWO_CODES = {"key": "crc", "type": "in", "values": ["TCP_HIT", "err_dns_fail"]}
HITS = {"key": "crc_class", "type": "eq", "value": "hit"}


def triage(spark: SparkSession, sf_dir: str, minutes: float = MONTH, **request) -> Triage:
    return Triage(raw_logs(spark, sf_dir), TriageRequest(window_minutes=minutes, **request))


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six decimals: the last bits of an interpolation differ from engine to engine."""
    return frame.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes])


# ---- the same in SQL -------------------------------------------------------------------------------------------------

LOGS = """
WITH raw AS (
  SELECT event_id AS row_id, CASE WHEN event_id % 101 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS ts_ms,
    CASE WHEN event_id % 97 = 0 THEN '' WHEN user_id % 3 = 0 THEN 'Live ' ELSE 'VOD' END AS delivery_service,
    CASE WHEN event_id % 53 = 0 THEN 'https://origin.example.com/x' ELSE 'https://edge-' || ['use1', 'usw2', 'usw1', 'EUW1', 'apse1'][user_id % 5 + 1]
      || '-' || ['iad', 'sjc', 'dfw', 'mia', 'ord', 'lhr'][user_id % 6 + 1] || '.cdn.example.com/seg.ts' END AS url,
    CASE WHEN event_id % 89 = 0 THEN '' WHEN event_type = 'error' THEN ['ERR_CONNECT_FAIL', 'err_read_timeout', 'ERR_DNS_FAIL'][event_id % 3 + 1]
      WHEN event_type = 'click' THEN 'TCP_HIT' WHEN event_type = 'view' THEN 'TCP_MISS' WHEN event_type = 'purchase' THEN 'TCP_REFRESH_HIT'
      WHEN event_id % 2 = 0 THEN 'TCP_CLIENT_REFRESH' ELSE 'TCP_DENIED' END AS raw_crc,
    CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 211 = 0 THEN 'abc' WHEN event_id % 199 = 0 THEN '600'
      WHEN event_type = 'error' THEN ['502', '503', '504'][event_id % 3 + 1] WHEN event_id % 7 = 0 THEN '404' WHEN event_id % 5 = 0 THEN '304' ELSE '200' END AS raw_status,
    CASE WHEN event_id % 166 = 0 THEN '200' ELSE '' END AS other_status,
    CASE WHEN event_id % 71 = 0 THEN 0.0 WHEN event_id % 139 = 0 THEN NULL ELSE value END AS ttms,
    CASE WHEN event_id % 61 = 0 THEN 0.0 WHEN event_id % 113 = 0 THEN 2.0 WHEN event_type IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END AS cache
  FROM events
), logs AS (
  SELECT *, coalesce(nullif(lower(trim(delivery_service)), ''), 'unknown') AS service,
    coalesce(nullif(lower(regexp_extract(url, '://edge-([A-Za-z0-9]+)-([A-Za-z0-9]+)', 1)), ''), 'unknown') AS region,
    coalesce(nullif(lower(regexp_extract(url, '://edge-([A-Za-z0-9]+)-([A-Za-z0-9]+)', 2)), ''), 'unknown') AS pop,
    coalesce(nullif(upper(raw_crc), ''), 'UNKNOWN') AS crc,
    TRY_CAST(coalesce(nullif(raw_status, ''), other_status) AS DOUBLE) AS status,
    coalesce(nullif(raw_status, ''), other_status) AS status_text
  FROM raw
), rows AS (
  SELECT *, CASE WHEN crc = 'UNKNOWN' THEN 'unknown' WHEN starts_with(crc, 'ERR_') THEN 'error'
    WHEN crc IN ('TCP_HIT', 'TCP_CF_HIT', 'TCP_REF_FAIL_HIT', 'TCP_REFRESH_HIT') THEN 'hit' WHEN crc IN ('TCP_MISS', 'TCP_REFRESH_MISS') THEN 'miss'
    WHEN crc = 'TCP_CLIENT_REFRESH' THEN 'client' ELSE 'other' END AS crc_class FROM logs
), newest AS (SELECT max(ts_ms) AS anchor_ms FROM rows)
"""


def within(minutes: int, where: str = "TRUE") -> str:
    """The tables win (the window) and f (of it, the rows that match)."""
    return LOGS + f", win AS (SELECT rows.* FROM rows, newest WHERE ts_ms BETWEEN anchor_ms - {minutes}::BIGINT * 60000 AND anchor_ms), f AS (SELECT * FROM win WHERE {where}) "


def rate(count: str) -> str:
    return f"CASE WHEN count(*) > 0 THEN round({count}::DOUBLE / count(*) * 100, 6) END"


BAD = "count(*) FILTER (WHERE status >= 500)"
HIT, MISS = "count(*) FILTER (WHERE cache = 1)", "count(*) FILTER (WHERE cache = 0)"
P95, P99 = "round(quantile_cont(ttms, 0.95), 6)", "round(quantile_cont(ttms, 0.99), 6)"
KPIS = f"""SELECT count(*)::BIGINT AS total, ({HIT})::BIGINT AS hit_count, ({MISS})::BIGINT AS miss_count, {rate(HIT)} AS hit_pct, {rate(MISS)} AS miss_pct,
  ({BAD})::BIGINT AS error_count, {rate(BAD)} AS error_pct, (count(*) FILTER (WHERE status IS NULL))::BIGINT AS missing_edge_status, {P95} AS p95_ms, {P99} AS p99_ms FROM f"""
CODES = "SELECT status AS code, count(*)::BIGINT AS count FROM f WHERE status IS NOT NULL GROUP BY 1 ORDER BY 1"
DQ = """SELECT count(*)::BIGINT AS rows, (count(*) FILTER (WHERE ts_ms IS NULL))::BIGINT AS invalid_ts, (count(*) FILTER (WHERE status IS NULL))::BIGINT AS missing_edge_status,
  (count(*) FILTER (WHERE service = 'unknown'))::BIGINT AS unknown_service, (count(*) FILTER (WHERE crc = 'UNKNOWN'))::BIGINT AS unknown_crc,
  (count(*) FILTER (WHERE region = 'unknown'))::BIGINT AS unknown_region, (count(*) FILTER (WHERE pop = 'unknown'))::BIGINT AS unknown_pop FROM """
SPAN = ", s AS (SELECT greatest(1.0, coalesce((max(ts_ms) - min(ts_ms)) / 60000.0::DOUBLE, 0.0)) AS span_minutes FROM f), b AS (SELECT span_minutes, CASE WHEN span_minutes <= 180 THEN 60 ELSE 900 END::BIGINT AS bucket_seconds FROM s) "
POINTS = f"""SELECT ts_ms - ts_ms % (bucket_seconds * 1000) AS bucket_ms, count(*)::BIGINT AS total, (count(*) FILTER (WHERE status >= 500 AND status < 600))::BIGINT AS errors_5xx,
  {rate("count(*) FILTER (WHERE status >= 500 AND status < 600)")} AS error_pct, {P95} AS p95_ms, {P99} AS p99_ms FROM f, b GROUP BY 1"""
SERIES = f", series AS ({POINTS}) "


STATUS_VALUE = "CASE WHEN status IS NOT NULL THEN CAST(status AS BIGINT)::VARCHAR WHEN status_text <> '' THEN 'NaN' ELSE '' END"


def top_sql(column: str, limit: int, source: str = "f") -> str:
    return f"SELECT {column} AS value, count(*)::BIGINT AS count, min(row_id) AS first_row FROM {source} WHERE {column} <> '' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT {limit}"


def available_sql(limits: dict[str, int]) -> str:
    names = {"edge_status": STATUS_VALUE}
    parts = [f"SELECT '{c}' AS field, row_number() OVER (ORDER BY count DESC, first_row)::INT AS place, value, count, first_row FROM (SELECT {names.get(c, c)} AS value, count(*)::BIGINT AS count, min(row_id) AS first_row FROM win GROUP BY 1) WHERE value <> '' QUALIFY place <= {n}" for c, n in limits.items()]
    return " UNION ALL ".join(parts)


# ---- queries ---------------------------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _kpi(name: str, minutes: int, where: str = "TRUE", **request) -> None:
    query(name, within(minutes, where) + KPIS)(lambda s, d: rounded(triage(s, d, minutes, **request).kpis()))


_kpi("kpi_window_60", 60)
_kpi("kpi_window_1440", DAY)
_kpi("kpi_window_43200", MONTH)
_kpi("kpi_service_live", MONTH, "service = 'live'", service=" LIVE ")
_kpi("kpi_region_pop", MONTH, "region = 'usw2' AND pop = 'sjc'", region="usw2", pop="SJC")
_kpi("filter_status_range_5xx", MONTH, "status BETWEEN 500 AND 599", filters=(ERRORS_5XX,))
_kpi("filter_status_eq", MONTH, "status = 404", filters=(NOT_FOUND,))
_kpi("filter_crc_in", MONTH, "crc IN ('TCP_HIT', 'ERR_DNS_FAIL')", filters=(TWO_CODES,))
_kpi("filter_crc_class_eq", MONTH, "crc_class = 'hit'", filters=(HITS,))
_kpi("filter_conjunction", MONTH, "service = 'vod' AND crc_class = 'hit' AND CASE WHEN status_text = '' THEN 0 ELSE status END BETWEEN 0 AND 404", service="vod", filters=(HITS, {"key": "edge_status", "type": "range", "min": 0, "max": 404}))
_kpi("filter_no_match", MONTH, "FALSE", filters=(ERRORS_5XX, NOT_FOUND))
_kpi("filter_pass_through", DAY, filters=({"type": "eq", "value": 1}, {"key": "crc", "type": "like"}, None))
_kpi("filter_bad_bound", DAY, "FALSE", filters=({"key": "edge_status", "type": "range", "min": "x", "max": 9999},))


@query("kpi_all", LOGS + ", f AS (SELECT * FROM rows) " + KPIS)
def kpi_all(s, d):
    return rounded(metrics.kpis(triage(s, d).logs))


query("status_distribution", within(MONTH) + CODES)(lambda s, d: metrics.status_counts(triage(s, d).filtered))
query("status_top12", within(MONTH) + CODES + " LIMIT 12")(lambda s, d: metrics.status_counts(triage(s, d).filtered).limit(12))
for _column in ("service", "region", "pop", "crc_class"):
    query(f"top_{_column}", within(MONTH) + top_sql(_column, 4))(lambda s, d, c=_column: metrics.top(triage(s, d).filtered, c, 4))
query("top_crc_ties", within(60) + top_sql("crc", 6))(lambda s, d: metrics.top(triage(s, d, 60).filtered, "crc", 6))
query("top_error_crc", within(MONTH, "status >= 500") + top_sql("crc", 4))(lambda s, d: metrics.top(metrics.errors(triage(s, d).filtered), "crc", 4))
query("available_values", within(DAY) + available_sql(metrics.available_limits(8, 12)))(lambda s, d: metrics.top_of_each(triage(s, d, DAY).windowed, metrics.available_limits(8, 12)))
query("dq_all", LOGS + DQ + "rows")(lambda s, d: quality.counters(triage(s, d).logs))
query("dq_window", within(DAY) + DQ + "win")(lambda s, d: quality.counters(triage(s, d, DAY).windowed))


@query("warnings_counts", within(DAY, "service = 'live'") + "SELECT (SELECT count(*) FROM win)::BIGINT AS windowed, (SELECT count(*) FROM f)::BIGINT AS filtered, (SELECT count(*) FROM win WHERE status IS NULL)::BIGINT AS missing_edge_status, (SELECT count(*) FROM win WHERE ts_ms IS NULL)::BIGINT AS invalid_ts")
def warnings_counts(s, d):
    t = triage(s, d, DAY, service="live")
    return quality.warning_counts(t.windowed, t.filtered)


query("anchor_window", LOGS + f"SELECT anchor_ms, anchor_ms - {DAY} * 60000 AS start_ms, anchor_ms AS end_ms FROM newest")(lambda s, d: triage(s, d, DAY).anchor())


@query("span_bucket_choice", " UNION ALL ".join(f"SELECT * FROM ({within(m)} {SPAN} SELECT {m}::BIGINT AS window_minutes, round(span_minutes, 6) AS span_minutes, bucket_seconds FROM b)" for m in (60, 240, DAY)))
def span_bucket_choice(s, d):
    frames = [window.span(triage(s, d, m).filtered).withColumn("window_minutes", F.lit(m).cast("long")) for m in (60, 240, DAY)]
    return rounded(frames[0].unionByName(frames[1]).unionByName(frames[2]).select("window_minutes", "span_minutes", "bucket_seconds"))


query("timeseries_60s", within(60) + SPAN + POINTS)(lambda s, d: rounded(triage(s, d, 60).timeseries()))
query("timeseries_900s", within(DAY) + SPAN + POINTS)(lambda s, d: rounded(triage(s, d, DAY).timeseries()))
query("timeseries_envelope", within(DAY) + SPAN + SERIES + "SELECT (SELECT bucket_seconds FROM b) AS bucket_seconds, min(bucket_ms) AS start_ms, max(bucket_ms) AS end_ms, count(*)::BIGINT AS points FROM series")(lambda s, d: metrics.envelope(triage(s, d, DAY).filtered))
query("latency_percentiles", within(MONTH) + f"SELECT {P95} AS p95_ms, {P99} AS p99_ms FROM f")(lambda s, d: rounded(triage(s, d).kpis().select("p95_ms", "p99_ms")))
query("cache_ratios", within(MONTH) + f"SELECT {rate(HIT)} AS hit_pct, {rate(MISS)} AS miss_pct FROM f")(lambda s, d: rounded(triage(s, d).kpis().select("hit_pct", "miss_pct")))
query("error_rate", within(MONTH) + f"SELECT ({BAD})::BIGINT AS error_count, {rate(BAD)} AS error_pct FROM f")(lambda s, d: rounded(triage(s, d).kpis().select("error_count", "error_pct")))
query("url_region_pop", LOGS + "SELECT row_id, region, pop FROM rows")(lambda s, d: triage(s, d).logs.frame.select("row_id", "region", "pop"))
query("crc_class_map", LOGS + "SELECT crc, crc_class, count(*)::BIGINT AS count FROM rows GROUP BY ALL")(lambda s, d: triage(s, d).logs.frame.groupBy("crc", "crc_class").agg(F.count(F.lit(1)).alias("count")))
query("service_canonical", LOGS + "SELECT service, count(*)::BIGINT AS count FROM rows GROUP BY ALL")(lambda s, d: triage(s, d).logs.frame.groupBy("service").agg(F.count(F.lit(1)).alias("count")))
query("status_alias", LOGS + "SELECT row_id, status AS edge_status FROM rows")(lambda s, d: triage(s, d).logs.frame.select("row_id", text.no_nan(F.col("edge_status")).alias("edge_status")))
query("latency_alias", LOGS + "SELECT row_id, ttms AS ttms_ms FROM rows")(lambda s, d: (lambda t: t.logs.frame.select("row_id", metrics.latency(t.logs).alias("ttms_ms")))(triage(s, d)))
query("iso_format", LOGS + "SELECT row_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM rows WHERE ts_ms IS NOT NULL")(lambda s, d: triage(s, d).logs.frame.where("ts_ms is not null").select("row_id", times.iso(F.col("ts_ms")).alias("iso")))


@query("sample_row", within(DAY, "service = 'live'") + "SELECT row_id, service, region, pop, crc, crc_class, status AS edge_status, ttms AS ttms_ms, url FROM f ORDER BY row_id LIMIT 1")
def sample_row(s, d):
    t = triage(s, d, DAY, service="live")
    return metrics.first_row(t.filtered, t.windowed, ["service", "region", "pop", "crc", "crc_class", "edge_status", "ttms_ms", "url"])


query("chart_last48", within(DAY) + SPAN + SERIES + "SELECT * FROM series ORDER BY bucket_ms DESC LIMIT 48")(lambda s, d: rounded(charts.last_points(triage(s, d, DAY).timeseries())))
query("chart_minmax", within(DAY) + SPAN + SERIES + ", l AS (SELECT * FROM series ORDER BY bucket_ms DESC LIMIT 48) SELECT coalesce(min(p95_ms), 0.0::DOUBLE) AS low, coalesce(max(p95_ms), 1.0::DOUBLE) AS high, arg_max(p95_ms, bucket_ms) FILTER (WHERE p95_ms IS NOT NULL) AS latest FROM l")(lambda s, d: rounded(charts.value_range(triage(s, d, DAY).timeseries(), "p95TtmsMs")))
query("chart_heights", within(DAY) + SPAN + SERIES + ", l AS (SELECT * FROM series ORDER BY bucket_ms DESC LIMIT 48), r AS (SELECT min(total) AS low, max(total) AS high FROM l) SELECT bucket_ms, round(greatest(6.0::DOUBLE, (total - low)::DOUBLE / CASE WHEN high = low THEN 1 ELSE high - low END * 100), 6) AS height FROM l, r")(lambda s, d: rounded(charts.heights(triage(s, d, DAY).timeseries(), "totalRequests")))


@query("history_top10", LOGS + "SELECT row_id AS id, ts_ms AS timestamp FROM rows WHERE ts_ms IS NOT NULL ORDER BY ts_ms DESC, row_id DESC LIMIT 10")
def history_top10(s, d):
    runs = triage(s, d).logs.frame.where("ts_ms is not null").select(F.col("row_id").alias("id"), F.col("ts_ms").alias("timestamp"))
    return runs.orderBy(F.desc("timestamp"), F.desc("id")).limit(10)


def _values(column: str, limit: int, source: str) -> str:
    """A report's list of top values as a scalar."""
    value = STATUS_VALUE if column == "edge_status" else column
    return f"(SELECT coalesce(string_agg(value || ' (' || count || ')', ', ' ORDER BY count DESC, first_row), 'n/a') FROM ({top_sql('value', limit, f'(SELECT *, {value} AS value FROM {source})')}))"


def _pct(x: str) -> str:
    """Two decimals of the exact value; only eighths can lie halfway, and are moved up."""
    return f"(SELECT printf('%.2f', CASE WHEN x * 8 = floor(x * 8) THEN x + 0.001 ELSE x END) || '%' FROM (SELECT {x} AS x FROM f))"


def _share(count: str) -> str:
    return f"({count})::DOUBLE / count(*)::DOUBLE * 100"


def _percentile(p: str) -> str:
    at = f"({p}::DOUBLE * (len(l) - 1))"
    low, high = (f"l[{g}({at})::BIGINT + 1]" for g in ("floor", "ceil"))
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


def _number(x: str) -> str:
    return f"(SELECT CASE WHEN x IS NULL THEN 'null' WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END FROM (SELECT ({x})::DOUBLE AS x))"


def _iso(ms: str) -> str:
    return f"(strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


def _quality(source: str) -> str:
    """Data quality as JSON."""
    named = [("invalid_ts", "ts_ms IS NULL"), ("missing_edge_status", "status IS NULL"), ("unknown_service", "service = 'unknown'"), ("unknown_crc", "crc = 'UNKNOWN'"), ("unknown_region", "region = 'unknown'"), ("unknown_pop", "pop = 'unknown'")]
    return "(SELECT '{' || " + " || ',' || ".join(f"'\"{n}\":' || count(*) FILTER (WHERE {c})" for n, c in named) + f" || '}}' FROM {source})"


SORTED = "(SELECT coalesce(list_sort(list(ttms)), []) AS l FROM f WHERE ttms IS NOT NULL)"
MS95, MS99 = (f"(SELECT floor({_percentile(p)} + 0.5)::BIGINT || ' ms' FROM {SORTED})" for p in ("0.95", "0.99"))
BOUNDS = f"{_iso('anchor_ms - ' + str(DAY * 60_000))}", _iso("anchor_ms")
MISSING = "(SELECT 'Some rows missing edge_status (' || count(*) || '). Response code totals may not sum perfectly.' FROM win WHERE status IS NULL HAVING count(*) > 0)"


def _summary_sql() -> str:
    start, end = BOUNDS
    lacking = [("missing edge_status", "status IS NULL"), ("unknown service", "service = 'unknown'"), ("unknown crc", "crc = 'UNKNOWN'"), ("unknown region", "region = 'unknown'"), ("unknown pop", "pop = 'unknown'")]
    dq = "'{\"all\":' || " + _quality("rows") + " || ',\"window\":' || " + _quality("win") + " || '}'"
    first = """(SELECT '{"ts":"' || raw_ts || '","service":"' || service || '","region":"' || region || '","pop":"' || pop || '","crc":"' || crc || '","crc_class":"' || crc_class || '","edge_status":'
      || CASE WHEN status IS NULL THEN CASE WHEN status_text = '' THEN '""' ELSE 'null' END ELSE status::BIGINT::VARCHAR END || ',"ttms_ms":' || CASE WHEN ttms = floor(ttms) THEN ttms::BIGINT::VARCHAR ELSE ttms::VARCHAR END
      || ',"url":"' || url || '"}' FROM f ORDER BY row_id LIMIT 1)"""
    lines = [
        "'🧭 *CDN TRIAGE SUMMARY*'",
        "'• Scope: service=`live`  region=`all`  pop=`all`'",
        f"'• Window: `{DAY}m`  • Time (UTC): `' || {start} || '` → `' || {end} || '`'",
        "'• Filters: `none`'",
        f"'⚠️ *Warnings*' || chr(10) || '• ' || {MISSING}",
        "(SELECT '⚠️ *Data Quality (window)*' FROM win WHERE status IS NULL OR 'unknown' IN (service, lower(crc), region, pop) LIMIT 1)",
        *[f"(SELECT CASE WHEN count(*) > 0 THEN '• {n}: ' || count(*) END FROM win WHERE {c})" for n, c in lacking],
        "'📊 *Traffic & Performance*'",
        "(SELECT '• Requests: *' || count(*) || '*' FROM f)",
        f"'• P95 TTMS: *' || {MS95} || '*'",
        f"'• P99 TTMS: *' || {MS99} || '*'",
        f"'• Cache Hit: *' || {_pct(_share(HIT))} || '*  (miss ' || {_pct(_share(MISS))} || ')'",
        "'🧮 *Response Codes*'",
        f"(SELECT string_agg('• ' || code::BIGINT || ': *' || count || '*', chr(10) ORDER BY code) FROM ({CODES} LIMIT 12))",
        "'🧩 *Top breakdowns*'",
        *[f"'• {c}: ' || {_values(c, 4, 'f')}" for c in ("service", "region", "pop", "crc_class")],
        "'🧾 *Evidence*'",
        f"(SELECT '• Error responses are dominated by `' || value || '` (' || count || ' of ' || (SELECT {BAD} FROM f) || ').' FROM ({top_sql('crc', 1, '(SELECT * FROM f WHERE status >= 500)')}))",
        f"(SELECT '• Error responses: ' || {BAD} || '/' || count(*) FROM f) || ' (' || {_pct(_share(BAD))} || ').'",
        f"'• Cache hit ratio ' || {_pct(_share(HIT))} || ' (miss ' || {_pct(_share(MISS))} || ').'",
        f"'• Latency p95/p99 TTMS = ' || {MS95} || '/' || {MS99} || '.'",
        "''",
        "'```'",
        "'--- DEBUG ---'",
        *[f"(SELECT 'rows_{n}=' || count(*) FROM {t})" for n, t in (("total", "rows"), ("inWindow", "win"), ("filtered", "f"))],
        f"'anchor=' || {end}",
        f"'start=' || {start}",
        f"'end=' || {end}",
        *[f"'avail_{c}=' || {_values(c, 12 if c == 'edge_status' else 8, 'win')}" for c in ("service", "region", "pop", "crc_class", "crc", "edge_status")],
        f"'data_quality=' || {dq}",
        f"'warnings=' || coalesce({MISSING}, 'none')",
        f"'sample=' || {first}",
        "'```'",
    ]
    stamps = within(DAY, "service = 'live'").replace("SELECT event_id AS row_id,", "SELECT event_id AS row_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS raw_ts,", 1)
    return stamps + f"SELECT array_to_string(list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL), chr(10)) AS summary FROM newest"


def _metrics_sql() -> str:
    start, end = BOUNDS

    def share(count: str) -> str:
        return _number(f"SELECT {_share(count)} FROM f")

    def latency(p: str) -> str:
        return _number(f"SELECT {_percentile(p)} FROM {SORTED}")

    def counts(name: str, column: str, source: str) -> str:
        return f"""(SELECT coalesce(string_agg('{{"{name}":"' || value || '","count":' || count || '}}', ',' ORDER BY count DESC, first_row), '') FROM ({top_sql(column, 4, source)}))"""

    five = "count(*) FILTER (WHERE status >= 500 AND status < 600)"
    points = f"""(SELECT string_agg('{{"ts":"' || {_iso("bucket_ms")} || '","totalRequests":' || n || ',"error5xxCount":' || bad || ',"errorRatePct":' || {_number("share")}
      || ',"p95TtmsMs":' || {_number(f"CASE WHEN len(l) > 0 THEN {_percentile('0.95')} END")} || ',"p99TtmsMs":' || {_number(f"CASE WHEN len(l) > 0 THEN {_percentile('0.99')} END")} || '}}', ',' ORDER BY bucket_ms)
      FROM (SELECT ts_ms - ts_ms % (bucket_seconds * 1000) AS bucket_ms, count(*) AS n, {five} AS bad, {_share(five)} AS share, coalesce(list_sort(list(ttms) FILTER (WHERE ttms IS NOT NULL)), []) AS l FROM f, b GROUP BY 1))"""
    edge = "(SELECT {0}(ts_ms) - {0}(ts_ms) % (any_value(bucket_seconds) * 1000) FROM f, b)"
    parts = [
        f"""'{{"timeRangeUTC":{{"start":"' || {start} || '","end":"' || {end} || '"}}'""",
        "',\"totalRequests\":' || (SELECT count(*) FROM f)",
        f"',\"p95TtmsMs\":' || {latency('0.95')} || ',\"p99TtmsMs\":' || {latency('0.99')}",
        f"',\"cacheHitPct\":' || {share(HIT)} || ',\"cacheMissPct\":' || {share(MISS)}",
        f"""',"statusCounts":[' || (SELECT string_agg('{{"code":' || code::BIGINT || ',"count":' || count || '}}', ',' ORDER BY code) FROM ({CODES})) || ']'""",
        f"',\"error5xxCount\":' || (SELECT {BAD} FROM f) || ',\"errorRatePct\":' || {share(BAD)}",
        f"',\"topCrcClass\":[' || {counts('crc_class', 'crc_class', 'f')} || '],\"topErrorCrc\":[' || {counts('crc', 'crc', '(SELECT * FROM f WHERE status >= 500)')} || ']'",
        f"""',"timeseries":{{"bucketSeconds":' || (SELECT bucket_seconds FROM b) || ',"startTs":"' || {_iso(edge.format("min"))} || '","endTs":"' || {_iso(edge.format("max"))} || '","points":[' || {points} || ']}}'""",
        f"""',"warnings":[' || coalesce('"' || {MISSING} || '"', '') || ']'""",
        f"',\"dataQuality\":{{\"all\":' || {_quality('rows')} || ',\"window\":' || {_quality('win')} || '}},\"debug\":null}}'",
    ]
    return within(DAY) + SPAN + f"SELECT {' || '.join(parts)} AS metrics FROM newest"


def stored(s: SparkSession, d: str, minutes: float, **request) -> Triage:
    """The log table written by day and read again."""
    path = store.scratch_path(s, f"logs-{uuid.uuid4().hex}")
    store.write(triage(s, d).logs, path)
    return Triage.stored(store.read(s, path), TriageRequest(window_minutes=minutes, **request))


def from_csv(s: SparkSession, d: str, minutes: float) -> Triage:
    """The log table written as a folder of CSV files, each with a header, and read again."""
    path = store.scratch_path(s, f"csv-{uuid.uuid4().hex}")
    frame = raw_logs(s, d).frame
    frame.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").drop("row_id").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
    return Triage(read_csv(s, path), TriageRequest(window_minutes=minutes))


query("stored_kpis_day", within(DAY, "service = 'live'") + KPIS)(lambda s, d: rounded(stored(s, d, DAY, service="live").kpis()))
query("stored_timeseries", within(DAY) + SPAN + POINTS)(lambda s, d: rounded(stored(s, d, DAY).timeseries()))
query("stored_top_crc", within(MONTH) + top_sql("crc", 6))(lambda s, d: metrics.top(stored(s, d, MONTH).filtered, "crc", 6))
query("csv_folder_kpis", within(MONTH) + KPIS)(lambda s, d: rounded(from_csv(s, d, MONTH).kpis()))
query("csv_folder_dq", LOGS + DQ + "rows")(lambda s, d: quality.counters(from_csv(s, d, MONTH).logs))
query("csv_folder_top_crc", within(60) + f"SELECT value, count FROM ({top_sql('crc', 6)})")(lambda s, d: metrics.top(from_csv(s, d, 60).filtered, "crc", 6).select("value", "count"))

#: Columns that may stand for another: three of latency, each blank where the one before it is needed, a service column beside none of delivery, and a region column.
ALIASES = """SELECT event_id AS row_id, round(CASE WHEN event_id % 4 <> 0 THEN value WHEN event_id % 3 <> 0 THEN value + 1 WHEN event_id % 5 <> 0 THEN value + 2 ELSE 0.0::DOUBLE END, 6) AS ttms_ms,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'vod' END AS service, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'use1' END AS region,
  CASE WHEN event_id % 53 = 0 THEN 'unknown' ELSE ['iad', 'sjc', 'dfw', 'mia', 'ord', 'lhr'][user_id % 6 + 1] END AS pop,
  CASE WHEN event_id % 6 <> 0 THEN 404.0::DOUBLE WHEN event_id % 9 <> 0 THEN 502.0::DOUBLE END AS edge_status FROM events"""


@query("column_aliases", ALIASES)
def column_aliases(s, d):
    events = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("row_id"), "value")
    raw = raw_logs(s, d).frame.select("row_id", "ts", "url").join(events, "row_id")

    def blank(n: int, value: Column | str) -> Column:
        return F.when(F.pmod("row_id", F.lit(n)) == 0, " ").otherwise(value)

    cells = {
        "ts": F.col("ts"), "url": F.col("url"), "service": blank(7, " VOD"), "region": blank(11, "USE1"), "http_status": blank(6, "404"), "response_code": blank(9, "502"),
        "ttms_ms": blank(4, F.col("value").cast("string")), "ttms": blank(3, (F.col("value") + 1).cast("string")), "time_to_first_byte": blank(5, (F.col("value") + 2).cast("string")),
    }
    logs = canonicalize(Raw(raw.select("row_id", *[c.alias(n) for n, c in cells.items()]), {n: n for n in cells}))
    return rounded(logs.frame.select("row_id", metrics.latency(logs).alias("ttms_ms"), "service", "region", "pop", "edge_status"))


@query("summary_text", _summary_sql())
def summary_text(s, d):
    return triage(s, d, DAY, service="live", debug=True).report_frame().select("summary")


@query("metrics_json", _metrics_sql())
def metrics_json(s, d):
    return triage(s, d, DAY).report_frame().select("metrics")
