import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from edgelight import queries
from edgelight.operators.canonical import canonicalize
from edgelight.sources.events import raw_logs
from edgelight.streaming.live import live_series

SQL = sorted(queries.ORACLE_SQL)


def same(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{small}/events.parquet'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_query_agrees_with_sql(spark, small, duck, name):
    frame = queries.QUERIES[name](spark, small)
    names = sorted(frame.columns)
    relation = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(relation.columns) == names
    got = sorted(repr([same(r[n]) for n in names]) for r in frame.collect())
    at = [relation.columns.index(n) for n in names]
    assert got == sorted(repr([same(r[i]) for i in at]) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_sums_hold(spark, small):
    t = queries.triage(spark, small)
    k, parts = t.kpis().first(), t.timeseries().collect()
    assert sum(p["total"] for p in parts) == k["total"]
    assert sum(p["errors_5xx"] for p in parts) <= k["error_count"] <= k["total"]
    assert k["hit_count"] + k["miss_count"] <= k["total"] and k["p95_ms"] <= k["p99_ms"]
    codes = queries.QUERIES["status_distribution"](spark, small).collect()
    assert sum(c["count"] for c in codes) + k["missing_edge_status"] == k["total"]


def test_stream_gives_the_batch_series(spark, small, tmp_path):
    """Every bucket but those that the watermark has not passed, with exact percentiles; rows come in three files, so in several batches."""
    raw = raw_logs(spark, small)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    thirds = raw.frame.withColumn("third", F.ntile(3).over(Window.orderBy("ts")))
    for i in (1, 2, 3):  # files are taken in the order in which they were written
        thirds.where(F.col("third") == i).drop("third").coalesce(1).write.mode("append").parquet(source)
    stream = type(raw)(spark.readStream.schema(raw.frame.schema).option("maxFilesPerTrigger", 1).parquet(source), raw.columns)

    def keep(series, number):
        series.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = live_series(canonicalize(stream), keep, late="0 seconds").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    batch = {r["bucket_ms"]: tuple(r) for r in queries.rounded(queries.metrics.timeseries(canonicalize(raw), 60)).collect()}
    live = queries.rounded(spark.read.parquet(out).drop("batch").select("bucket_ms", "total", "errors_5xx", "error_pct", "p95_ms", "p99_ms")).collect()
    assert len(live) == len({r["bucket_ms"] for r in live}) >= len(batch) - 1 and all(batch[r["bucket_ms"]] == tuple(r) for r in live)
