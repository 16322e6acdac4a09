"""Tables written between the rounds of an iterative operator.

A written table cuts lineage, survives the loss of any executor, and costs
compressed columnar bytes only. The folder is the one the cluster names in
``spark.checkpoint.dir``; a private temporary folder is used only where that is
unset and the master is local.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="kinweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + own)
    return "file://" + own


class Scratch:
    """Written intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """As ``save``, with the number of rows, counted while they are written."""
        seen = Observation()
        return self.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name), int(seen.get["n"])

    def hashed(self, df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        """As ``counted``, with the sum of the rows' hashes: equal for equal sets of rows."""
        seen = Observation()
        mark = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")), name)
        return out, int(seen.get["n"]), int(seen.get["mark"] or 0)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, name: str) -> None:
        """Delete a table no later plan reads."""
        fs, path = self._path(name)
        fs.delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Delete all tables of the run but the named ones, which a lazy result still reads."""
        fs, path = self._path()
        if fs.exists(path):
            for status in fs.listStatus(path):
                if status.getPath().getName() not in names:
                    fs.delete(status.getPath(), True)
