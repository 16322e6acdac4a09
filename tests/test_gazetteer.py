from pyspark.sql import functions as F

from kinweave.operators import gazetteer as gz

from .conftest import rows

CITIES = "name string, population long, country string, admin1 string, canonical string, key string"


def places(spark):
    data = [("Seoul-si", 900, "KR", "11", "Seoul", "x"), ("서울", 900, "KR", "11", "Seoul", "x"), ("Paris", 50, "US", "TX", "Paris (Texas)", "x"), ("Paris", 2000, "FR", "A", "Paris", "x"), ("Myeong-dong", 0, "KR", "11", "Myeong-dong", "x"), ("부천", 5, "KR", "13", "Bucheon", "x"), (None, 5, "KR", "13", "N", "x"), ("X", 1, "KR", "1", "X", "x")]
    return spark.createDataFrame(data, CITIES)


def test_table_of_names(spark):
    countries = spark.createDataFrame([("France", "FR"), ("Paris", "XX")], "name string, code string")
    admin1 = spark.createDataFrame([("Bavaria", "DE", "")], "name string, country string, region string")
    got = {r["key"]: (r["city"], r["country"], r["region"]) for r in gz.place_table(places(spark), countries, admin1).collect()}
    assert got["paris"] == ("Paris", "FR", "") and got["seoul"] == ("Seoul", "KR", "서울") and got["서울"] == ("Seoul", "KR", "서울")
    assert got["myeongdong"] == ("Myeong-dong", "KR", "서울") and got["부산"] == ("", "KR", "부산") and got["울산"] == ("", "KR", "기타")
    assert got["france"] == ("", "FR", "") and got["uk"] == ("", "GB", "") and got["bavaria"] == ("", "DE", "") and "x" not in got
    assert gz.place_table(places(spark).limit(0)).count() == len(gz.DIVISIONS) + len(gz.SHORT_COUNTRIES)


def test_fragments_with_their_neighbours(spark):
    df = spark.createDataFrame([("1", ["Hall", "Paris", "TX"], "a"), ("2", ["부천시", "KR"], "b"), ("3", ["FR.", "US", "Seoul"], "c"), ("4", None, "d"), ("5", [None, "", "Nowhere", "CA"], "e")], "id string, parts array<string>, key string")
    got = rows(gz.resolve_fragments(df, "id", F.col("parts"), gz.place_table(places(spark)), {"FR": "FR", "US": "US", "KR": "KR"}), "id", "pos", "city", "country", "region")
    assert got == [("1", 2, "Paris", "FR", ""), ("1", 3, "", "FR", ""), ("2", 1, "Bucheon", "KR", "경기"), ("2", 2, "", "KR", "경기"), ("3", 1, "", "FR", ""), ("3", 2, "", "FR", ""), ("3", 3, "Seoul", "KR", "서울")]
