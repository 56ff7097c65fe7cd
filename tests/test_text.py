import math

import pytest
from pyspark.sql import functions as F

from edgelight.functions import edge, text, times
from edgelight.sources.csv import cells


def values(spark, column, inputs, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


def test_trim_takes_all_white_space(spark):
    assert values(spark, text.trim, [" ﻿ a b\t ", "", None]) == ["a b", "", None]
    assert values(spark, text.lower, [" Live ", None]) == ["live", ""]


def test_number(spark):
    given = ["0x1F4", "5e2", "500d", "inf", "Infinity", "abc", " 500 ", "", "-.5", "5.", "0b101", "0o17", "1_0", "NaN", None]
    want = [500.0, 500.0, math.nan, math.nan, math.inf, math.nan, 500.0, 0.0, -0.5, 5.0, 5.0, 15.0, math.nan, math.nan, math.nan]
    for g, w in zip(values(spark, text.number, given), want, strict=True):
        assert g == w or math.isnan(g) and math.isnan(w)


def test_request_numbers_follow_the_rules_of_cells(spark):
    given = ["0x1F4", "5e2", "500d", "inf", "Infinity", "abc", " 500 ", "", "-.5", "5.", "0b101", "0o17", "1_0", "NaN"]
    for g, w in zip(given, values(spark, text.number, given), strict=True):
        assert text.read_number(g) == w or math.isnan(text.read_number(g)) and math.isnan(w)
    assert [text.read_number(v) for v in ([], ["7"], True, 3, None)] == [0, 7, 1, 3, 0] and math.isnan(text.read_number([1, 2])) and math.isnan(text.read_number({}))


def test_number_text(spark):
    assert values(spark, text.number_text, [200.0, 12.5, 1e7, 0.1, 12345678.5, math.nan, math.inf], "double") == ["200", "12.5", "10000000", "0.1", "12345678.5", "NaN", "Infinity"]


@pytest.mark.parametrize(
    "given,ms",
    [
        ("2024-01-01T00:00:00.120Z", 1704067200120),
        ("2024-01-01T00:00:00", 1704067200000),
        ("2024-01-01 05:30:00+05:30", 1704067200000),
        (" 2024-01-01T00:00:00.9999999Z ", 1704067200999),
        ("1969-12-31T23:59:59.1239", -877),
        ("10:00", None),
        ("2024", None),
        ("2024-13-01T00:00:00Z", None),
        ("", None),
        (None, None),
    ],
)
def test_timestamps(spark, given, ms):
    assert values(spark, times.parse_ms, [given]) == [ms]


def test_buckets_and_iso(spark):
    assert values(spark, lambda c: times.bucket_ms(c, F.lit(60)), [61_000, -1], "long") == [60_000, -60_000]
    assert values(spark, times.bucket_seconds, [180.0, 180.01], "double") == [60, 900]
    assert values(spark, times.iso, [1704067200120], "long") == ["2024-01-01T00:00:00.120Z"]


def test_codes_and_hosts(spark):
    given = ["", "UNKNOWN", "ERR_HIT", "TCP_HIT", "TCP_REFRESH_MISS", "TCP_CLIENT_REFRESH", "TCP_DENIED"]
    assert values(spark, edge.crc_class, given) == ["unknown", "unknown", "error", "hit", "miss", "client", "other"]
    urls = ["HTTPS://EDGE-Use1-IAD.cdn/x", "https://origin/x", "https://edge-a-b_c/x", None]
    assert values(spark, edge.region_of, urls) == ["use1", None, None, None]
    assert values(spark, edge.pop_of, urls)[0] == "iad"


def test_cells(spark):
    given = ['a,b', '"a,b",c', 'x""y,z', '"a""b",c', 'ab"c,d"e,f', '"open, rest', " a , ' b '"]
    want = [["a", "b"], ["a,b", "c"], ["xy", "z"], ['a"b', "c"], ["abc,de", "f"], ["open, rest"], ["a", "' b '"]]
    for g, w in zip(values(spark, cells, given), want, strict=True):
        assert [c for c in g][: len(w)] == w and not any(g[len(w) :])
