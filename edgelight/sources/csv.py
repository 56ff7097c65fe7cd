"""Reading CSV the strict way: quotes toggle anywhere in a line, and a line is a row whatever its quotes say."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from urllib.request import urlopen

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.canonical import Raw

#: A cell: anything but commas and quotes, or quoted stretches, of which the last may lack its end.
CELL = r'((?:[^",]|"[^"]*(?:"|$))*)(?:,|$)'


NO_ROWS = "Parsed 0 rows from CSV. Check delimiter/quotes/header line."
#: Files whose names and places are sent to all executors; with more the lines are joined with them by a shuffle.
MOST_BROADCAST_FILES = 100_000
#: A packed file is one split, but may hold so many times the lines of a plain one of its size.
SPLITS_FOR_PACKED = 32
FETCH_SECONDS, LINES_AT_ONCE = 60, 10_000


class InputError(ValueError):
    """An input that cannot be triaged; the message is for the user."""


def cells(line: Column) -> Column:
    """array<string> of a line: quotes off, doubled quotes as one, white space trimmed, then one quote at either end off."""
    raw = F.regexp_extract_all(line, F.lit(CELL), F.lit(1))

    def clean(c: Column) -> Column:
        # A doubled quote inside quotes is kept under another name while the quotes themselves go.
        opened = F.regexp_replace(c, r'"((?:[^"]|"")*)(?:"|$)', "$1")
        return text.strip_edge_quotes(text.trim(F.regexp_replace(opened, '""', '"')))

    return F.transform(raw, clean)


def _tidy(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", "\r$", ""))


def _table(body: DataFrame, header: str) -> Raw:
    """body: row_id and line, without the header. Blank lines are no rows; of columns with one name the last counts."""
    names = list(body.sparkSession.range(1).select(cells(text.trim(F.lit(header))).alias("names")).first()["names"])
    if names and names[-1] == "":  # the pattern also matches the empty rest of a line
        names.pop()
    columns = {name: f"c{i}" for i, name in enumerate(names)}
    body = body.where(text.filled(F.col("line"))).select("row_id", cells(F.col("line")).alias("cells"))
    used = sorted({int(c[1:]) for c in columns.values()})
    frame = body.select("row_id", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in used])
    return Raw(frame, columns)


def _rows(lines: DataFrame) -> Raw:
    """lines: row_id and line, in order from partition to partition. The first that is not blank is the header; only the partitions up to it are read for that."""
    lines = _tidy(lines)
    first = lines.where(text.filled(F.col("line"))).select("row_id", "line").first()
    if first is None:
        raise InputError(NO_ROWS)
    return _table(lines.where(F.col("row_id") > first["row_id"]), first["line"])


def read_csv(spark: SparkSession, path: str) -> Raw:
    """A CSV file or folder of any file system that Spark reads; row_id follows the order of lines (of files by name).

    Each file of a folder has a header, its first line that is not blank; the first file's names the columns. Lines are numbered without being counted: the
    number of a line's split, by the sizes of the files before it and its start in its file, times more lines than a task reads, plus its place in its task.
    """
    found = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    columns = [meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start")]
    lines = _tidy(found.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"), *columns))
    if len(found.inputFiles()) < 2:
        return _rows(lines.select(F.col("at").alias("row_id"), "line"))
    said = F.when(text.filled(F.col("line")), F.col("at"))
    heads = lines.groupBy("file").agg(F.max("size").alias("size"), F.min(said).alias("head"), F.min_by("line", said).alias("header"))
    files = sorted(heads.collect())  # a row for each file, as the driver's own list of files has
    header = next((f["header"] for f in files if f["header"] is not None), None)
    if header is None:
        raise InputError(NO_ROWS)
    most, least = (_bytes(spark, f"spark.sql.files.{key}") for key in ("maxPartitionBytes", "openCostInBytes"))
    split = max(1, min(most, least))  # Spark cuts files into equal splits, none smaller
    places = 2 * most + 2  # a task reads splits of no more than most bytes, and a line has a byte at least
    base, ranks = 0, []
    for f in files:
        ranks.append((f["file"], base, f["head"]))
        base += SPLITS_FOR_PACKED * (f["size"] // split + 1)
    if base * places >= 1 << 63:
        raise InputError("Too many bytes to number their lines; read fewer files at a time.")
    ranks = spark.createDataFrame(ranks, "file string, base long, head long")
    lines = lines.join(F.broadcast(ranks) if len(files) <= MOST_BROADCAST_FILES else ranks, "file").where("head is null or at <> head")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return _table(lines.select(((F.col("base") + F.floor(F.col("start") / split)) * places + place).alias("row_id"), "line"), header)


def _bytes(spark: SparkSession, key: str) -> int:
    """A setting in bytes, such as 128MB or 4194304b."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(key).lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.removesuffix("b") if len(unit) > 1 else unit]


def read_text(spark: SparkSession, csv_text: str) -> Raw:
    """CSV text in hand, such as an upload."""
    if not csv_text:
        raise InputError("No CSV text found.")
    lines = csv_text.strip("\t\n\x0b\f\r  ﻿").split("\n")
    return _rows(spark.createDataFrame(list(enumerate(lines)), "row_id long, line string"))


def _fetched(batches: Iterator) -> Iterator:
    """Lines of the addresses in a batch, a bounded number at a time, so that no task holds a whole answer."""
    import pandas as pd

    for batch in batches:
        for url in batch["url"]:
            with urlopen(url, timeout=FETCH_SECONDS) as answer:
                lines = enumerate(line.decode("utf-8-sig" if i == 0 else "utf-8", "replace").rstrip("\n") for i, line in enumerate(answer))
                while some := list(islice(lines, LINES_AT_ONCE)):
                    yield pd.DataFrame(some, columns=["row_id", "line"])


def read_url(spark: SparkSession, url: str) -> Raw:
    """CSV over HTTP, fetched by one task, as one answer comes in one stream, and kept in the executors' cache; a lost executor's part is fetched again.

    The answer's lines pass neither the driver nor a local file.
    """
    lines = spark.createDataFrame([(url,)], "url string").coalesce(1).mapInPandas(_fetched, "row_id long, line string").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lines.count()
    except PySparkException as error:
        lines.unpersist()
        reason = re.search(r"(?:HTTPError|URLError|ValueError|TimeoutError|OSError): .*", str(error))
        raise InputError(f"Failed to fetch csvUrl ({reason[0] if reason else type(error).__name__})") from error
    return _rows(lines)


def raw_table(frame: DataFrame, row_id: str) -> Raw:
    """A DataFrame with string columns and a column that gives the order of its rows."""
    names = [c for c in frame.columns if c != row_id]
    return Raw(frame.select(F.col(row_id).cast("long").alias("row_id"), *[F.col(c).cast("string").alias(c) for c in names]), {c: c for c in names})
