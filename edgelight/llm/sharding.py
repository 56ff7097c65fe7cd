"""A reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import free_column

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers (the constants are those of the public SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The images of numbers under a permutation of 0..size-1 that seed fixes.

    A balanced Feistel network permutes the next power of four; an image beyond size is fed back (cycle walking) until it
    falls below, which keeps the whole a permutation. The power is under 4 * size, so that takes few steps on average.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(seed % (1 << 63)) * np.uint64(1_000_003))

    def network(x):
        left, right = x >> width, x & low
        for key in keys:
            left, right = right, left ^ (_mix(right ^ key) & low)
        return (left << width) | right

    out = np.asarray(numbers).astype(np.uint64)
    walking = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walking):
            out[walking] = network(out[walking])
            walking = walking[out[walking] >= size]
    return out.astype(np.int64)


def permuted(number: Column, size: int, seed: int) -> Column:
    @F.pandas_udf(LongType())
    def image(n: pd.Series) -> pd.Series:
        return pd.Series(permute(n.to_numpy(), size, seed))

    return image(number)


def numbered(df: DataFrame, key: list[Column], name: str, buckets: int = 8192) -> DataFrame:
    """df with a gapless global row number from 0, the same on each run.

    Rows are dealt into buckets by a hash of key and numbered within each bucket in order of hash and key; a bucket starts
    where the ones before it end. buckets fixes the size of the table of starts, so that it may be broadcast. Rows that
    agree in key share a number range in either order: where key holds all that is returned, results do not depend on it.
    """
    h, b, start = (free_column(df, x) for x in ("_hash", "_bucket", "_start"))
    hashed = df.withColumn(h, F.xxhash64(*key)).withColumn(b, F.pmod(F.col(h), F.lit(buckets)).cast("int"))
    counts = hashed.groupBy(b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(b).orderBy(F.col(h), *key)
    ranked = hashed.withColumn(name, F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), b).withColumn(name, F.col(name) + F.col(start)).drop(h, b, start)


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deals documents into shards whose numbers of rows differ by one at most (law `rows`).

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, row_number, position (its image under the
    permutation of 0..rows-1), shard = position mod shards and slot = position div shards: shard and slot of a row can be
    computed from its number alone. A null text counts as no bytes; a null id is an id like others. Repeated rows each get
    a place of their own; which of several equal rows gets which place is not told apart by any returned column. An empty
    table gives an empty result. Other columns are left out.
    """
    text = F.col(text_column)
    narrow = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = docs.count()
    placed = numbered(narrow, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "row_number")
    placed = placed.withColumn("position", permuted(F.col("row_number"), rows, seed))
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))


def op2_feistel_shards(spark, sf_dir):
    from .common import documents

    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
