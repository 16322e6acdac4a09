"""Content-addressed pages: every body once, one manifest row per fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH = "url string, fetched_at timestamp, status int, content_type string, content binary"


def append(spark: SparkSession, root: str, fetches: DataFrame) -> None:
    """Add fetches: bodies not held yet go to ``bodies`` (partitioned by hash), all fetches to ``manifest``.

    The manifest is written last, so a reader never meets a row without its body.
    """
    rows = fetches.withColumn("sha256", F.sha2("content", 256))
    new = rows.dropDuplicates(["sha256"]).select("sha256", "content", F.substring("sha256", 1, 2).alias("shard"))
    held = bodies(spark, root)
    if held is not None:
        new = new.join(held.select("sha256"), "sha256", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(f"{root}/bodies")
    rows.drop("content").write.mode("append").parquet(f"{root}/manifest")


def bodies(spark: SparkSession, root: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/bodies")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema("sha256 string, content binary, shard string").parquet(f"{root}/bodies") if fs.exists(p) else None


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The last successful fetch of each URL."""
    m = spark.read.parquet(f"{root}/manifest").filter("status BETWEEN 200 AND 299")
    best = m.groupBy("url").agg(F.max_by(F.struct("fetched_at", "status", "content_type", "sha256"), F.struct("fetched_at", "sha256")).alias("b"))
    return best.select("url", "b.*")


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(url, how) of pages added, removed or with other content than before."""
    j = before.select("url", F.col("sha256").alias("b")).join(now.select("url", F.col("sha256").alias("n")), "url", "full_outer")
    how = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b") != F.col("n"), "changed")
    return j.select("url", how.alias("how")).filter("how IS NOT NULL")
