"""Rate guards and incremental merging over streams; each has the batch form it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import upsert

#: Fixed values of the guard: requests a minute, distinct resources in ten minutes.
PER_MINUTE, DISTINCT_IN_TEN = 120, 80


def busy_minutes(requests: DataFrame, key: str, ts: str, most: int = PER_MINUTE, late: str | None = None) -> DataFrame:
    """(key, minute, n): minutes in which a key sent more than ``most`` requests.

    ``late`` sets a watermark for a stream; a batch needs none. Null keys or times
    are left out.
    """
    r = requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    if late:
        r = r.withWatermark(ts, late)
    n = r.groupBy(F.window(ts, "1 minute").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") > most).select(key, F.col("w.start").alias("minute"), "n")


def wide_readers(requests: DataFrame, key: str, ts: str, resource: str, most: int = DISTINCT_IN_TEN, late: str | None = None) -> DataFrame:
    """(key, since, n): sliding ten-minute windows in which a key read more than about ``most`` distinct resources.

    Streams keep a sketch per window, not the resources, so state stays bounded.
    """
    r = requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    if late:
        r = r.withWatermark(ts, late)
    n = r.groupBy(F.window(ts, "10 minutes", "1 minute").alias("w"), key).agg(F.approx_count_distinct(resource, 0.02).alias("n"))
    return n.filter(F.col("n") > most).select(key, F.col("w.start").alias("since"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n): bursts of events no further apart than ``gap``."""
    e = events.withWatermark(ts, late) if late else events
    s = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merge_batches(path: str, keys: list[str], columns: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that upserts each batch into versioned parquet folders, so a repeated batch changes nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")) if fs.exists(p) else []
        before = [v for v in done if v < epoch + 1]
        table = spark.read.parquet(f"{path}/v={before[-1]}") if before else spark.createDataFrame([], batch.select(*keys, *columns).schema)
        upsert(table, batch.select(*keys, *columns), keys, columns).drop("how").write.mode("overwrite").parquet(f"{path}/v={epoch + 1}")

    return sink
