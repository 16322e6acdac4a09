from pyspark.sql import functions as F

from kinweave.llm.layouts import activity_copies, activity_records, copies_of_records

from ..conftest import rows

COLS = "activity_id string, ledger_id string, title string, venue string, year string, id string, key string"


def acts(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], COLS)


def test_layouts_of_one_record(spark):
    df = acts(spark, [
        ("2", "l", "Kitchen: Bridge", "The Hall (Town)", "2017"),
        ("1", "l", "KITCHEN  BRIDGE", "TOWN, the hall", "2017년"),
        ("3", "l", "“Kitchen” bridge.", "the hall - town", "(2017)"),
        ("4", "l", "Bridge Kitchen", "The Hall (Town)", "2017"),
        ("5", "l", "Kitchen: Bridge 2", "The Hall (Town)", "2017"),
        ("6", "m", "Kitchen: Bridge", "The Hall (Town)", "2017"),
        ("7", "l", None, "The Hall (Town)", "2017"),
        ("8", "l", None, "The Hall (Town)", "2017"),
        ("9", "l", "Kitchen: Bridge", " ", "2017"),
        ("A", "l", "Kitchen: Bridge", " ", "2017"),
        ("B", None, "X", "Y", "2000"),
        ("C", None, "X", "Y", "2000"),
        ("D", "l", "…", "Y", "2000"),
        ("E", "l", " … ", "Y", "2000"),
        ("F", "l", "?", "Y", "2000"),
        ("G", "l", "ΦΩΣ Straße", "Z", "2001"),
        ("H", "l", "Φως: STRASSE", "z", "2001"),
    ])
    assert rows(activity_copies(df)) == [("1", "2"), ("1", "3"), ("D", "E"), ("G", "H")]
    assert rows(activity_records(df)) == [("1", 3), ("D", 2), ("G", 2)]
    assert activity_copies(df.limit(0)).count() == 0


def test_a_group_across_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(f"{i:05d}", "same") for i in range(4000)] + [(f"x{i:05d}", f"k{i // 3}") for i in range(3000)]
        df = spark.createDataFrame(data, "i string, k string").repartition(7)
        got = rows(copies_of_records(df, "i", F.col("k")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted([("00000", f"{i:05d}") for i in range(1, 4000)] + [(f"x{i - i % 3:05d}", f"x{i:05d}") for i in range(3000) if i % 3])
    assert got == want


def test_null_keys_long_texts_and_repeated_ids(spark):
    df = spark.createDataFrame([("1", None), ("2", None), (None, "a"), ("3", "a"), ("4", "b" * 100000), ("5", "b" * 100000), ("6", "c"), ("6", "c")], "i string, k string")
    assert rows(copies_of_records(df, "i", F.col("k"))) == [("4", "5"), ("6", "6")]
