"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on (the time zone) and what lets plans adapt to the data they meet.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", app: str = "edgelight") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one that spark-submit gives."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.showConsoleProgress", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
