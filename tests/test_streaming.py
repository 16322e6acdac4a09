import datetime as dt

from pyspark.sql import functions as F

from kinweave.operators.merge import upsert
from kinweave.streaming import guard

from .conftest import rows


def requests(spark):
    t0 = dt.datetime(2026, 1, 1, 10, 0, 0)
    data = [("busy", t0 + dt.timedelta(seconds=i % 55), f"r{i}") for i in range(130)] + [("calm", t0 + dt.timedelta(seconds=i), "r") for i in range(20)] + [(None, t0, "r")]
    return spark.createDataFrame(data, "k string, ts timestamp, res string")


def test_stream_and_batch_guards_agree(spark, tmp_path):
    src = str(tmp_path / "in")
    requests(spark).write.parquet(src)
    late = spark.createDataFrame([("end", dt.datetime(2026, 1, 1, 12, 0, 0), "r")], "k string, ts timestamp, res string")
    late.write.mode("append").parquet(src)
    batch = rows(guard.busy_minutes(requests(spark), "k", "ts"), "k", "n")
    stream = spark.readStream.schema("k string, ts timestamp, res string").option("maxFilesPerTrigger", 100).parquet(src)
    q = guard.busy_minutes(stream, "k", "ts", late="1 minute").writeStream.outputMode("append").format("memory").queryName("busy").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert batch == [("busy", 130)] and rows(spark.table("busy"), "k", "n") == batch


def test_wide_readers_and_sessions(spark):
    wide = guard.wide_readers(requests(spark), "k", "ts", "res").groupBy("k").count()
    assert rows(wide, "k") == [("busy",)]
    assert rows(guard.sessions(requests(spark).filter("k = 'calm'"), "k", "ts", "5 seconds"), "k", "n") == [("calm", 20)]


def test_repeated_batches_change_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    sink = guard.merge_batches(out, ["k"], ["v"])
    a = spark.createDataFrame([("1", "x"), ("2", "")], "k string, v string")
    b = spark.createDataFrame([("2", "y"), ("3", "z"), ("1", "other")], "k string, v string")
    sink(a, 0)
    sink(b, 1)
    first = rows(spark.read.parquet(f"{out}/v=2"), "k", "v")
    sink(b, 1)
    assert rows(spark.read.parquet(f"{out}/v=2"), "k", "v") == first == [("1", "x"), ("2", "y"), ("3", "z")]
    assert upsert(a.limit(0), a, ["k"], ["v"]).count() == 2
