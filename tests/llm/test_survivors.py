from pyspark.sql import functions as F

from kinweave.llm.survivors import artist_survivors, time_of, truths, value_of

from ..conftest import rows

COLS = "ledger_id string, gy_id string, name_en string, affiliation string, country string, verification string, updated_at string, source_type string, g string, i string, t string"


def table(spark, data):
    return spark.createDataFrame([(*r, "S", "x", "y", "z") for r in data], COLS)


def test_verified_then_latest_then_smallest(spark):
    df = table(spark, [
        ("3", "g", "A", "X", "KR", "UNVERIFIED", "2026-01-01T00:00:00Z"),
        ("2", "g", "B", None, "N/A", "VERIFIED", "2024-01-01"),
        ("1", "g", "C", " ", "미상", "VERIFIED", "2024-01-01 00:00:00"),
        ("5", "h", "A", None, None, "UNVERIFIED", "2025-01-01T10:00:00+09:00"),
        ("4", "h", "B", "Y", "unknown", "UNVERIFIED", "2025-01-01T02:00:00Z"),
        ("6", "h", "D", "Z", "?", "UNVERIFIED", "pending"),
        ("7", "solo", "A", "X", "KR", "VERIFIED", None),
        ("8", None, "A", "X", "KR", "VERIFIED", None),
        ("9", " ", "A", "X", "KR", "VERIFIED", None),
        ("10", " ", "A", "X", "KR", "VERIFIED", None),
    ])
    assert rows(artist_survivors(df)) == sorted([("g", "name_en", "1"), ("g", "affiliation", "3"), ("g", "country", "3"), ("h", "name_en", "4"), ("h", "affiliation", "4")])
    assert artist_survivors(df.limit(0)).count() == 0


def test_times_in_all_notations(spark):
    df = spark.createDataFrame([(x,) for x in ("2024-03-05", "2024-03-05T00:00:00Z", "2024-03-05 00:00:00", "2024-03-05T09:00:00+09:00", "2024-03-04T19:00:00-0500", "2024/03/05", "", "pending", None, "2024-13-40")], "c string")
    got = [r[0] for r in df.select(F.unix_micros(time_of(F.col("c")))).collect()]
    assert len(set(got[:6])) == 1 and got[0] is not None and got[6:] == [None] * 4


def test_values_and_stand_ins(spark):
    df = spark.createDataFrame([(x,) for x in (" a ", "", "　", "TBD", "--", None, "NA")], "c string")
    assert [r[0] for r in df.select(value_of(F.col("c"))).collect()] == ["a", None, None, None, None, None, "NA"]


def test_truths_follow_reliable_sources_and_may_keep_several(spark):
    data = []
    for g in range(40):
        for k, s in enumerate(("good", "fair", "bad")):
            wrong = s == "bad" or (s == "fair" and g % 5 == 0)
            data.append((f"{g}-{k}", f"g{g}", "False" if wrong and s == "bad" else ("Odd" if wrong else "True"), None, None, "V", None, s, "x", "y", "z"))
    df = spark.createDataFrame(data, COLS)
    got = truths(df, "gy_id", ("name_en", "country"), ["source_type"])
    kept = dict(rows(got.filter("kept").groupBy("value").count()))
    assert kept.get("True", 0) >= 32 and kept.get("False", 0) == 0
    both = table(spark, [("1", "g", "A", None, None, "V", None), ("2", "g", "B", None, None, "V", None)])
    assert truths(both.limit(0), "gy_id", ("name_en",), ["source_type"]).count() == 0
    assert truths(both, "gy_id", ("name_en",), ["source_type"]).count() == 2
