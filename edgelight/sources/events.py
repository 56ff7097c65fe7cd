"""A raw edge-log table made of the generic `events` table, by fixed rules on its integer columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import Raw

REGIONS = ["use1", "usw2", "usw1", "EUW1", "apse1"]
POPS = ["iad", "sjc", "dfw", "mia", "ord", "lhr"]


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def raw_logs(spark: SparkSession, sf_dir: str) -> Raw:
    """Cells as a log shipper would write them, with blanks, odd statuses and untidy names planted."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    third = F.pmod(e, F.lit(3))

    def each(n: int) -> Column:
        return F.pmod(e, F.lit(n)) == 0

    host = F.concat(F.lit("https://edge-"), _pick(REGIONS, F.pmod(user, F.lit(5))), F.lit("-"), _pick(POPS, F.pmod(user, F.lit(6))), F.lit(".cdn.example.com/seg.ts"))
    crc = F.when(each(89), "").when(kind == "error", _pick(["ERR_CONNECT_FAIL", "err_read_timeout", "ERR_DNS_FAIL"], third)).when(kind == "click", "TCP_HIT").when(kind == "view", "TCP_MISS")
    crc = crc.when(kind == "purchase", "TCP_REFRESH_HIT").otherwise(F.when(each(2), "TCP_CLIENT_REFRESH").otherwise("TCP_DENIED"))
    status = F.when(each(83), "").when(each(211), "abc").when(each(199), "600").when(kind == "error", _pick(["502", "503", "504"], third)).when(each(7), "404").when(each(5), "304").otherwise("200")
    columns = {
        "ts": F.when(each(101), "").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        "delivery_service": F.when(each(97), "").when(F.pmod(user, F.lit(3)) == 0, "Live ").otherwise("VOD"),
        "url": F.when(each(53), "https://origin.example.com/x").otherwise(host),
        "crc": crc,
        "edge_status": status,
        "status": F.when(each(166), "200").otherwise(""),
        "ttms_ms": F.when(each(71), "").when(each(139), "slow").otherwise(F.col("value").cast("string")),
        "edge_cache_hit": F.when(each(61), "").when(each(113), "2").when(kind.isin("click", "purchase"), "1").otherwise("0"),
    }
    return Raw(events.select(e.alias("row_id"), *[c.alias(n) for n, c in columns.items()]), {n: n for n in columns})
