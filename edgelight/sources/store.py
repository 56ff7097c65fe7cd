"""Canonical logs at rest: Parquet, a folder for each day, sorted by time, so that a window reads its days and row groups only."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import Logs

ROWS, COLUMNS = "rows", "columns"
#: The day of rows without a valid time; no date is before it.
NO_DAY = "0000-00-00"


def write(logs: Logs, path: str, mode: str = "append") -> None:
    """Adds canonical rows to a table, new if there is none. Days are dealt out by ranges of time, so that a day with very many rows has many files.

    Rows without a valid time are kept in a day of their own, as counters of data quality ask for them. What the table's columns are is written beside the rows.
    """
    day = F.coalesce(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd"), F.lit(NO_DAY))
    rows = logs.frame.withColumn("day", day)
    parts = int(logs.frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows without a time would be one range; their order in the input tells them apart.
    placed = rows.repartitionByRange(parts, "day", "ts_ms", "row_id").sortWithinPartitions("day", "ts_ms")
    placed.write.mode(mode).partitionBy("day").parquet(f"{path}/{ROWS}")
    spark = logs.frame.sparkSession
    present = [(n, None) for n in sorted(logs.present)] + sorted(logs.others.items())
    spark.createDataFrame(present, "header string, column string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{COLUMNS}")


def read(spark: SparkSession, path: str) -> Logs:
    """The table's canonical rows."""
    known = spark.read.schema("header string, column string").parquet(f"{path}/{COLUMNS}").collect()  # a row for each column
    frame = spark.read.option("mergeSchema", "false").parquet(f"{path}/{ROWS}").withColumn("day", F.col("day").cast("string"))
    return Logs(frame, frozenset(r["header"] for r in known if r["column"] is None), {r["header"]: r["column"] for r in known if r["column"] is not None}, "day")


def newest_day(frame: DataFrame) -> str | None:
    """The newest day with rows that have a time: from the names of folders alone, which Spark has listed already."""
    days = {f.split("/day=", 1)[1].split("/", 1)[0] for f in frame.inputFiles()}
    return max((d for d in days if d > NO_DAY), default=None)


def newest_ms(logs: Logs) -> int | None:
    """The anchor: the newest time, read from the newest day."""
    day = newest_day(logs.frame)
    return None if day is None else logs.frame.where(F.col("day") == day).agg(F.max("ts_ms")).first()[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table that need not stay: in spark.checkpoint.dir, which the driver and executors share, or where that is unset (in tests) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared}/{name}" if shared else tempfile.mkdtemp(prefix=f"{name}-")
