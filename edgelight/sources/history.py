"""Past runs: a table of JSON records with a partition for each run, newest first. Nothing that is kept is ever written again."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["timestamp", "inputs", "summary", "metrics"]
#: id names the partition. A deleted run's partition holds one row that is marked gone in place of the record.
SCHEMA = "timestamp string, inputs string, summary string, metrics string, gone boolean, id string"
KEPT = 10


def _write(rows: DataFrame, path: str) -> None:
    """Replaces the partitions that rows are in, each when all of them are written, and leaves all others as they are: a write that fails changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").json(path)


def append(spark: SparkSession, path: str, inputs: dict, summary: str, metrics: dict, at: str | None = None) -> str:
    """Adds a run and returns its id."""
    run = uuid.uuid4().hex
    stamp = at or datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    _write(spark.createDataFrame([(stamp, json.dumps(inputs), summary, json.dumps(metrics), False, run)], SCHEMA).coalesce(1), path)
    return run


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path).where(~F.col("gone")).select("id", *FIELDS)


def newest(runs: DataFrame, limit: int = KEPT, order: str = "timestamp") -> DataFrame:
    return runs.orderBy(F.desc(order), F.desc("id")).limit(limit)


def bury(path: str, ids: DataFrame) -> None:
    """Puts a mark in place of the runs with these ids; their partitions are replaced, no other is read or written for that."""
    gone = [F.lit(None).cast("string").alias(c) for c in FIELDS]
    _write(ids.select(*gone, F.lit(True).alias("gone"), "id"), path)


def delete(spark: SparkSession, path: str, run: str) -> None:
    """Without effect where there is no such run."""
    bury(path, load(spark, path).where(F.col("id") == run).select("id"))


def prune(spark: SparkSession, path: str, limit: int = KEPT) -> None:
    runs = load(spark, path)
    bury(path, runs.join(newest(runs, limit).select("id"), "id", "left_anti").select("id"))


def clear(spark: SparkSession, path: str) -> None:
    bury(path, load(spark, path).select("id"))
