"""The vocabulary of edge logs: cache result codes, and where a host name says a request was served."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which cache result codes count as hits, misses and client refreshes.
HIT_CODES = ["TCP_HIT", "TCP_CF_HIT", "TCP_REF_FAIL_HIT", "TCP_REFRESH_HIT"]
MISS_CODES = ["TCP_MISS", "TCP_REFRESH_MISS"]
CLIENT_CODES = ["TCP_CLIENT_REFRESH"]
#: Fixed value: scheme separator, then edge-region-pop.
EDGE_HOST = r"(?i)://edge-([a-z0-9]+)-([a-z0-9]+)\b"


def crc_class(crc: Column) -> Column:
    """unknown, error, hit, miss, client or other, of an upper-case code; the order of the tests matters."""
    return (
        F.when((crc == "") | (crc == "UNKNOWN"), "unknown")
        .when(crc.startswith("ERR_"), "error")
        .when(crc.isin(HIT_CODES), "hit")
        .when(crc.isin(MISS_CODES), "miss")
        .when(crc.isin(CLIENT_CODES), "client")
        .otherwise("other")
    )


def region_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, EDGE_HOST, 1)), F.lit(""))


def pop_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, EDGE_HOST, 2)), F.lit(""))
