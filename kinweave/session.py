"""Session construction with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .shipping import ship

#: Settings every operator assumes. Shuffle partitions are left to AQE coalescing.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Build (or fetch) a session for local use; a cluster brings its own session."""
    b = SparkSession.builder.master(master).appName("kinweave")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g", **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
