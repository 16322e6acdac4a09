"""Parquet table access by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``; column pruning and filters reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
