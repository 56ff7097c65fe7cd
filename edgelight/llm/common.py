"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a longest run of bytes other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker is handed at once by the queries.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark hand rows to Python in batches of BATCH_BYTES, unless the session says otherwise; for queries, not for operators."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):  # its default
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir, one of our own only in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(wanted or f"{tempfile.gettempdir()}/edgelight-checkpoints")
    return sc.getCheckpointDir()


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they end; else these stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which survives lost executors and can be read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with short_lived_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    for tables in _scratch[-1:]:
        tables.append(out)
    return out


def _erase(*tables: DataFrame) -> None:
    """Deletes staged tables whole, which takes no job."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(conf).delete(path, True)


#: The staged tables of each open scratch(), the innermost last.
_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Empties the tables that are staged inside when it ends, but for those that the function it gives is called with; for one thread of the driver."""
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.staged_at)
        return table

    _scratch.append([])
    try:
        yield keep
    finally:
        tables = _scratch.pop()
        _erase(*[t for t in tables if t.staged_at not in kept])
        for outer in _scratch[-1:]:
            outer.extend(t for t in tables if t.staged_at in kept)


def discard(*tables: DataFrame) -> None:
    """Empties staged tables that nothing reads any more."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(t.staged_at)


def free_column(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores in front as make it differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: an operator that needs no others is free of clashes with them."""
    return df.select(*[df[n] for n in names])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with a gapless long from 0 in the given order.

    Rows are range-partitioned and sorted, written once, and each partition then adds the number of rows in the partitions
    before it: no task ever holds more than its range. The driver sees one count per partition.
    """
    spark, at = df.sparkSession, free_column(df, "_at")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = staged(placed)
    part = F.shiftright(F.col(at), 33).cast("int")
    counts = dict(placed.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    if not starts:
        return placed.withColumn(name, F.col(at)).drop(at)
    offsets = F.create_map(*[F.lit(x).cast(kind) for p, n in starts.items() for x, kind in ((p, "int"), (n, "long"))])
    return placed.withColumn(name, offsets[part] + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


def connected_components(nodes: DataFrame, links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node: the smallest node that links (a, b) lead to.

    Each round gives a node the smallest label among its own and its neighbours', then the label of its label, so that the
    number of rounds grows with the logarithm of the longest path. Hubs are no hot spot: minima are taken map-side first.
    Each round is staged; labels of nodes without links never take part.
    """
    edges = links.where("a <> b").select("a", "b")
    edges = staged(edges.union(edges.select("b", "a")).distinct())
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(rounds):
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        hop = lower.select(F.col("node").alias("via"), F.col("low").alias("far"))
        stepped = lower.join(hop, lower["low"] == hop["via"], "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "old")
        stepped = staged(stepped)
        discard(labels)
        labels = stepped
        if not stepped.where("label <> old").limit(1).count():
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    discard(edges)
    found = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return nodes.join(found, nodes["node"] == found["_n"], "left").select("node", F.coalesce("_l", "node").alias("component"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


__all__ = ["WORD", "Window", "all_of", "bounded_batches", "connected_components", "discard", "documents", "free_column", "global_rank", "named", "scratch", "shared_dir", "staged", "word_count"]
