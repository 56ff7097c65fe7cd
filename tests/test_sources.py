import pytest
from pyspark.sql import functions as F

from edgelight.operators import metrics
from edgelight.operators.canonical import canonicalize, normalized
from edgelight.plans.request import TriageRequest
from edgelight.plans.triage import Triage
from edgelight.sources import store
from edgelight.sources.csv import read_csv, read_text
from edgelight.sources.events import raw_logs

#: Lines with quotes, commas in quotes, a blank line, short and long rows, an open quote, and several columns for status and latency.
CSV = """ts,"delivery_service",url,crc,status,http_status,ttms,time_to_first_byte,note
2024-01-01T00:00:00Z, Live ,https://edge-use1-iad.cdn.example.com/a,tcp_hit,,502,"12.5",99,"a, ""b"" c"

2024-01-01T00:01:00Z,VOD,https://other.example.com/x,err_dns_fail,404,500,,7
bad,,,,x,503,abc,8,"open, to the end
2024-01-01T00:02:00Z,"li""ve",,TCP_MISS,0x10,,1e2,,z,more,cells"""


def test_csv_rows(spark):
    logs = canonicalize(read_text(spark, CSV))
    numbers = [F.col(c).cast("string") for c in ("edge_status", "ttms_ms")]
    got = logs.frame.orderBy("row_id").select("row_id", "ts_ms", "service", "region", "pop", "crc", "crc_class", *numbers, logs.others["note"]).collect()
    assert [tuple(r) for r in got] == [
        (1, 1704067200000, "live", "use1", "iad", "TCP_HIT", "hit", "502.0", "12.5", 'a, "b" c'),
        (3, 1704067260000, "vod", "unknown", "unknown", "ERR_DNS_FAIL", "error", "404.0", "7.0", ""),
        (4, None, "unknown", "unknown", "unknown", "UNKNOWN", "unknown", "NaN", "NaN", "open, to the end"),
        (5, 1704067320000, 'li"ve', "unknown", "unknown", "TCP_MISS", "miss", "16.0", "100.0", "z"),
    ]
    short = normalized(read_text(spark, CSV)).orderBy("row_id").select("row_id", "ts", "service", F.col("status").cast("string"), F.col("ttms").cast("string"), "crc").collect()
    assert [tuple(r) for r in short] == [
        (1, 1704067200000, "unknown", "0.0", "12.5", "tcp_hit"),
        (3, 1704067260000, "unknown", "404.0", "0.0", "err_dns_fail"),
        (4, None, "unknown", "NaN", "NaN", ""),
        (5, 1704067320000, "unknown", "16.0", "100.0", "TCP_MISS"),
    ]


@pytest.mark.parametrize("split", ["134217728", "20000"])
def test_lines_of_a_folder_keep_their_order(spark, small, tmp_path, split):
    """Every row of the table, in files of unequal length, each cut into one split or many."""
    path, frame = str(tmp_path / "csv"), raw_logs(spark, small).frame
    for i, (low, high) in enumerate([(0, 40), (40, 700), (700, 710), (710, 10**9)]):
        frame.where(F.col("row_id").between(low, high - 1)).orderBy("row_id").coalesce(1).write.mode("append").csv(f"{path}/{i}", header=True, quoteAll=True, escape='"', emptyValue="")
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": str(min(int(split), 4 << 20))}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        raw = read_csv(spark, f"{path}/*")
        rows = raw.frame.select("row_id", raw.cell("ts").alias("ts"), raw.cell("ttms_ms").alias("ttms_ms")).collect()
        assert split != "20000" or raw.frame.rdd.getNumPartitions() > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(r["ts"], r["ttms_ms"]) for r in frame.orderBy("row_id").collect()]
    assert [(r["ts"], r["ttms_ms"]) for r in sorted(rows)] == want and len({r["row_id"] for r in rows}) == len(want)


@pytest.fixture(scope="module")
def table(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs"))
    store.write(canonicalize(raw_logs(spark, small)), path)
    return path


@pytest.mark.parametrize("minutes", [60, 1440, 43200, 600_000])
def test_stored_rows_are_those_of_the_text(spark, small, table, minutes):
    request = TriageRequest(service="live", window_minutes=minutes)
    text, stored = Triage(raw_logs(spark, small), request), Triage.stored(store.read(spark, table), request)
    columns = text.filtered.frame.columns
    assert sorted(map(repr, stored.filtered.frame.select(columns).collect())) == sorted(map(repr, text.filtered.frame.collect()))
    assert stored.logs.present == text.logs.present and stored.logs.others == text.logs.others
    assert stored.logs.frame.count() == text.logs.frame.count()
    assert stored.report().metrics == text.report().metrics


def test_a_window_reads_its_days_only(spark, table):
    t = Triage.stored(store.read(spark, table), TriageRequest(window_minutes=1440))
    frame = t.windowed.frame.select("service")
    scan = next(line for line in frame._jdf.queryExecution().explainString(frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n") if "PartitionFilters" in line)
    days = {f.split("day=")[1][:10] for f in t.logs.frame.inputFiles()}
    read = {f["day"] for f in t.windowed.frame.select("day").distinct().collect()}
    assert "day" in scan and len(read) <= 2 < len(days)
    assert store.newest_ms(t.logs) == t.logs.frame.agg(F.max("ts_ms")).first()[0]


def test_stored_tables_grow_and_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    logs = canonicalize(read_text(spark, "ts,service,extra\n2024-01-01T00:00:00Z,a,x\nbad,b,y"))
    store.write(logs.with_frame(logs.frame.limit(0)), path)
    assert store.newest_ms(logs.with_frame(logs.frame.withColumn("day", F.lit("")).limit(0))) is None
    store.write(logs, path)
    store.write(logs, path)
    again = store.read(spark, path)
    assert again.frame.count() == 4 and again.frame.where("ts_ms is null").count() == 2 and again.others == {"extra": "cell_2"}
    assert store.newest_ms(again) == 1704067200000


def test_a_report_is_two_jobs_that_keep_nothing(spark, small):
    raw = raw_logs(spark, small)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    frame = Triage(raw, TriageRequest(window_minutes=1440, debug=True)).report_frame()
    assert frame.count() == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "percentile(" not in plan


def test_top_values_pass_a_group_limit(spark, small):
    frame = metrics.top_of_each(canonicalize(raw_logs(spark, small)), metrics.available_limits(8, 12))
    assert "WindowGroupLimit" in frame._jdf.queryExecution().executedPlan().toString()
