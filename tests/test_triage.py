import json
import math
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

from edgelight.operators import charts, metrics, quality
from edgelight.operators.canonical import canonicalize, normalized
from edgelight.operators.filters import restrict
from edgelight.plans.report import failure, figures, fixed_text, series
from edgelight.plans.request import TriageRequest
from edgelight.plans.triage import Triage
from edgelight.sources import history
from edgelight.sources.csv import InputError, read_csv, read_text, read_url

HEAD = "ts,delivery_service,url,crc,edge_status,ttms_ms,edge_cache_hit\n"


def logs(spark, csv, legacy=False):
    return canonicalize(read_text(spark, csv), legacy)


def rows(frame):
    return [tuple(r) for r in frame.orderBy("row_id").collect()]


def report(spark, csv, **request):
    return Triage(read_text(spark, csv), TriageRequest(**request)).report()


def test_presence_decides_the_source_of_dimensions(spark):
    t = logs(spark, "ts,delivery_service,service,region,url\n2024-01-01T00:00:00Z,,vod,,https://edge-use1-iad.x/\n")
    assert t.frame.select("service", "region", "pop").first() == ("unknown", "unknown", "iad")


def test_aliases_row_by_row(spark):
    t = logs(spark, "edge_status,status,http_status,response_code,ttms,time_to_first_byte\n,502,1,1,,7\n200,502,,,5,\n,,404,,,\n,,,0x1F4,,\n")
    assert rows(t.frame.select("row_id", "edge_status", "ttms_ms")) == [(1, 502.0, 7.0), (2, 200.0, 5.0), (3, 404.0, None), (4, 500.0, None)]
    k = metrics.kpis(t).first()
    assert k["p95_ms"] == pytest.approx(6.9) and k["hit_count"] == k["miss_count"] == 0


def test_blank_latency_and_cache_count_as_zero_where_the_columns_exist(spark):
    csv = HEAD + "2024-01-01T00:00:00Z,live,,TCP_HIT,,,\n2024-01-01T00:00:10Z,live,,TCP_HIT,x,x,x\n2024-01-01T00:00:20Z,live,,,200,10,1\n"
    k = metrics.kpis(logs(spark, csv)).first()
    assert (k["total"], k["hit_count"], k["miss_count"], k["missing_edge_status"]) == (3, 1, 1, 2)
    assert k["p95_ms"] == pytest.approx(9.5)
    absent = metrics.kpis(logs(spark, "ts,edge_status\n2024-01-01T00:00:00Z,200\n")).first()
    assert absent["p95_ms"] is None and absent["miss_count"] == 0


def test_errors_have_two_definitions(spark):
    csv = HEAD + "".join(f"2024-01-01T00:00:0{i}Z,live,,ERR_A,{s},1,0\n" for i, s in enumerate(["499", "500", "599", "600", "Infinity"]))
    t = logs(spark, csv)
    assert metrics.kpis(t).first()["error_count"] == 4
    assert metrics.timeseries(t).first()["errors_5xx"] == 2
    assert [r["code"] for r in metrics.status_counts(t).collect()] == [499, 500, 599, 600, math.inf]


def test_ties_go_by_first_appearance(spark):
    csv = HEAD + "".join(f"2024-01-01T00:00:0{i}Z,{s},,,,,\n" for i, s in enumerate(["vod", "live", "live", "vod", "aux"]))
    assert [(r["value"], r["count"]) for r in metrics.top(logs(spark, csv), "service").collect()] == [("vod", 2), ("live", 2), ("aux", 1)]


def test_filters(spark):
    csv = "ts,edge_status,ttms_ms,host\n" + "".join(f"2024-01-01T00:00:0{i}Z,{s},1,{h}\n" for i, (s, h) in enumerate([("200.0", "A"), ("", "b"), ("x", ""), ("12.5", " a ")]))
    t = logs(spark, csv)

    def kept(*filters, **dims):
        return [r["row_id"] for r in restrict(t, filters=filters, **dims).frame.orderBy("row_id").collect()]

    assert kept({"key": "edge_status", "type": "eq", "value": 200}) == [1]
    assert kept({"key": "edge_status", "type": "eq", "value": "12.50"}) == []
    assert kept({"key": "edge_status", "type": "eq", "value": ""}) == [2]
    assert kept({"key": "edge_status", "type": "eq", "value": "NaN"}) == [3]
    assert kept({"key": "edge_status", "type": "range", "min": 0, "max": 20}) == [2, 4]
    assert kept({"key": "edge_status", "type": "range", "min": math.nan}) == []
    assert kept({"key": "host", "type": "in", "values": ["A", "c"]}) == [1, 4]
    assert kept({"key": "nowhere", "type": "eq", "value": ""}) == [1, 2, 3, 4]
    assert kept({"key": "nowhere", "type": "range", "min": 0}) == []
    assert kept({"type": "eq", "value": 1}, None, {"key": "host", "type": "like"}) == [1, 2, 3, 4]
    assert kept(service="ALL") == [] and kept(service="") == [1, 2, 3, 4]
    a, b = {"key": "host", "type": "eq", "value": "a"}, {"key": "edge_status", "type": "range", "min": 100}
    assert kept(a, b) == kept(b, a) == kept(a, a, b) == [1]


def test_window_is_inclusive_and_anchored_on_the_newest_row(spark):
    stamps = ["2024-01-01T00:00:00Z", "2023-12-31T23:00:00.000Z", "2023-12-31T22:59:59.999Z", "bad", ""]
    t = Triage(read_text(spark, "ts,service\n" + "\n".join(f"{s},vod" for s in stamps)), TriageRequest())
    assert [r[0] for r in t.windowed.frame.select("row_id").orderBy("row_id").collect()] == [1, 2]
    assert quality.counters(t.logs).first()["invalid_ts"] == 2


@pytest.mark.parametrize("minutes,width", [(180, 60), (181, 900)])
def test_bucket_width_follows_the_span(spark, minutes, width):
    csv = f"ts,ttms_ms\n2024-01-01T00:00:00Z,1\n2024-01-01T{minutes // 60:02d}:{minutes % 60:02d}:00Z,2\n"
    e = metrics.envelope(logs(spark, csv)).first()
    assert (e["bucket_seconds"], e["points"]) == (width, 2)


def test_legacy_rules(spark):
    csv = HEAD + "2024-01-01T00:00:00Z,live,,,,,\n"
    old = logs(spark, csv, legacy=True)
    assert old.frame.select("edge_status", "ttms_ms").first() == (0.0, 0.0)
    assert quality.counters(old).first()["missing_edge_status"] == 0
    out = Triage(read_text(spark, csv), TriageRequest(), legacy=True).report()
    assert "timeseries" not in out.metrics and "P99" not in out.summary


def test_short_rows(spark):
    raw = read_text(spark, "timestamp,status,edge_status,ttms,error_reason,ttms_ms\n2024-01-01T00:00:00Z,502,200,,late,9\n")
    assert tuple(normalized(raw).first())[1:] == (1704067200000, "unknown", "unknown", "unknown", 502.0, 0.0, "late")


def test_csv_shapes(spark, tmp_path):
    path = tmp_path / "logs.csv"
    path.write_bytes('﻿ts,"service",x,x\r\n\r\n2024-01-01T00:00:00Z,vod,1,2,extra\r\n   \r\n2024-01-01T00:00:01Z\r\n'.encode())
    raw = read_csv(spark, str(path))
    assert list(raw.columns) == ["ts", "service", "x"]
    got = raw.frame.orderBy("row_id").select(raw.cell("ts"), raw.cell("service"), raw.cell("x")).collect()
    assert [tuple(r) for r in got] == [("2024-01-01T00:00:00Z", "vod", "2"), ("2024-01-01T00:00:01Z", "", "")]


def test_csv_folder(spark, tmp_path):
    for name, lines in {"a": "\n \nts,service\n1,x\n\n2,y\n", "b": "\n\nservice,ts\n3,z\n", "c": "\n", "d": "ts,service"}.items():
        (tmp_path / f"{name}.csv").write_text(lines)
    raw = read_csv(spark, str(tmp_path))
    got = raw.frame.orderBy("row_id").select("row_id", raw.cell("ts"), raw.cell("service")).collect()
    assert [tuple(r)[1:] for r in got] == [("1", "x"), ("2", "y"), ("3", "z")] and len({r["row_id"] for r in got}) == 3


def test_csv_folder_of_blank_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("\n \n")
    with pytest.raises(InputError, match="Parsed 0 rows"):
        read_csv(spark, str(tmp_path))


def test_csv_over_http(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿ts,service\r\n2024-01-01T00:00:00Z,vod\r\n".encode())
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path)))
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        raw = read_url(spark, f"{at}/x.csv")
        assert [tuple(r) for r in raw.frame.select(raw.cell("ts"), raw.cell("service")).collect()] == [("2024-01-01T00:00:00Z", "vod")]
        with pytest.raises(InputError, match="Failed to fetch csvUrl.*404"):
            read_url(spark, f"{at}/none.csv")
    finally:
        server.shutdown()


def test_figures_of_a_report():
    assert figures(None) is None and series({"timeseries": None}) is None
    assert figures({"totalRequests": "12", "p95TtmsMs": "7.5", "error5xxCount": 0}) == {"totalRequests": 12, "p95TtmsMs": 7.5, "p99TtmsMs": None, "error5xxCount": 0, "errorRatePct": None}
    read = series({"timeseries": {"bucketSeconds": "60", "startTs": "", "points": [{"ts": "a", "totalRequests": "x", "p95TtmsMs": "3"}, {"ts": ""}]}})
    assert read == {"bucketSeconds": 60, "startTs": None, "endTs": None, "points": [{"ts": "a", "totalRequests": 0, "error5xxCount": 0, "errorRatePct": 0, "p95TtmsMs": 3, "p99TtmsMs": None}]}
    assert series({"timeseries": {"points": "no list"}})["points"] == []


@pytest.mark.parametrize("csv,message", [("", "No CSV text"), ("ts,service", "Parsed 0 rows"), ("\n \n", "Parsed 0 rows"), ("ts,service\nx,vod", "No valid timestamps")])
def test_inputs_that_cannot_be_triaged(spark, csv, message):
    with pytest.raises(InputError, match=message) as error:
        report(spark, csv)
    assert failure(error.value) == {"ok": False, "error": str(error.value)}


ONE = HEAD + "2024-01-01T00:00:00.500Z,Live ,https://edge-use1-iad.x/a,err_a,502,-2.5,0\n2024-01-01T00:00:30Z,vod,https://o/a,TCP_HIT,200,10,1\n"


def test_report_text(spark):
    r = report(spark, ONE)
    assert r.summary.split("\n") == [
        "🧭 *CDN TRIAGE SUMMARY*",
        "• Scope: service=`all`  region=`all`  pop=`all`",
        "• Window: `60m`  • Time (UTC): `2023-12-31T23:00:30.000Z` → `2024-01-01T00:00:30.000Z`",
        "• Filters: `none`",
        "⚠️ *Data Quality (window)*",
        "• unknown region: 1",
        "• unknown pop: 1",
        "📊 *Traffic & Performance*",
        "• Requests: *2*",
        "• P95 TTMS: *9 ms*",
        "• P99 TTMS: *10 ms*",
        "• Cache Hit: *50.00%*  (miss 50.00%)",
        "🧮 *Response Codes*",
        "• 200: *1*",
        "• 502: *1*",
        "🧩 *Top breakdowns*",
        "• service: live (1), vod (1)",
        "• region: use1 (1), unknown (1)",
        "• pop: iad (1), unknown (1)",
        "• crc_class: error (1), hit (1)",
        "🧾 *Evidence*",
        "• Error responses are dominated by `ERR_A` (1 of 1).",
        "• Error responses: 1/2 (50.00%).",
        "• Cache hit ratio 50.00% (miss 50.00%).",
        "• Latency p95/p99 TTMS = 9 ms/10 ms.",
    ]
    assert r.metrics["timeseries"]["points"][0] == {"ts": "2024-01-01T00:00:00.000Z", "totalRequests": 2, "error5xxCount": 1, "errorRatePct": 50, "p95TtmsMs": 9.375, "p99TtmsMs": 9.875}
    assert r.metrics["topErrorCrc"] == [{"crc": "ERR_A", "count": 1}] and r.metrics["statusCounts"][1] == {"code": 502, "count": 1}
    json.dumps(r.response())


def test_no_match_keeps_blank_lines_and_warns(spark):
    r = report(spark, ONE, service="aux", filters=({"key": "crc", "type": "in", "values": ["A", "B"]},), debug=True)
    lines = r.summary.split("\n")
    assert lines[1:5] == ["No rows matched your filters.", "• Requested: service=`aux` region=`all` pop=`all` window=`60m`", "• Filters: `crc in (A,B)`", "• Available (this window):"]
    assert lines[10:14] == ["", "⚠️ *Warnings*", "• Filters removed all rows. Check available values in DEBUG.", ""]
    assert r.metrics["totalRequests"] == 0 and r.metrics["timeseries"]["points"] == []
    assert r.metrics["debug"]["sample"]["ttms_ms"] == -2.5


def test_empty_window(spark):
    assert report(spark, ONE, window_minutes=-5).summary.split("\n")[1] == "No data found in requested time window."


def test_warnings_compare_all_filters_together(spark):
    def warned(windowed, filtered, missing, *dims):
        counts = {"missing_edge_status": F.lit(missing), "invalid_ts": F.lit(0)}
        return spark.range(1).select(quality.warning_texts(F.lit(windowed), F.lit(filtered), counts, *dims)).first()[0]

    assert [w.split()[0] for w in warned(5, 5, 2, "vod", "all", "iad")] == ["Service", "POP", "Some"]
    assert warned(5, 4, 0, "vod", "all", "iad") == [] and warned(0, 0, 0, "vod", "a", "b") == []


def test_decimals_in_the_plan_are_those_of_the_exact_value(spark):
    values = [0.0, 1.005, 0.125, 0.375, 2.0, 100.0, 99.995, 0.005, 1e-9, 33.333333333333336, *[n / 799 * 100 for n in range(0, 800, 7)], *[n / 8 for n in range(50)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_text(F.col("v"))).collect()
    assert [r[1] for r in rows] == [charts.fixed(r[0]) for r in rows]


def test_numbers_as_text():
    assert [charts.fixed(x) for x in (1.005, 0.125, 2.0)] == ["1.00", "0.13", "2.00"]
    assert [charts.half_up(x) for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    assert [charts.label(m, 1234.5) for m in ("errorRatePct", "p95TtmsMs", "totalRequests")] == ["1234.50%", "1235 ms", "1,235"]
    assert charts.label("p95TtmsMs", None) == "n/a"


def test_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    ids = [history.append(spark, path, {"n": i}, "text", {}, f"2024-01-01T00:00:{i:02d}.000Z") for i in range(12)]
    assert [json.loads(r["inputs"])["n"] for r in history.newest(history.load(spark, path)).collect()] == list(range(11, 1, -1))
    history.delete(spark, path, ids[11])
    assert history.load(spark, path).count() == 11
    history.prune(spark, path)
    assert history.load(spark, path).count() == 10
    history.clear(spark, path)
    assert history.load(spark, path).count() == 0


def test_a_failure_loses_no_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    ids = [history.append(spark, path, {"n": i}, "text", {"a": 1}, f"2024-01-01T00:00:0{i}.000Z") for i in range(3)]
    before = sorted(history.load(spark, path).collect())
    broken = history.load(spark, path).select(F.when(F.col("id") == ids[1], F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        history.bury(path, broken)  # fails between reading and the end of writing
    assert sorted(history.load(spark, path).collect()) == before
    history.delete(spark, path, "no such run")
    assert sorted(history.load(spark, path).collect()) == before
    history.delete(spark, path, ids[0])
    history.delete(spark, path, ids[0])
    assert sorted(history.load(spark, path).collect()) == [r for r in before if r["id"] != ids[0]]
