from pyspark.sql import functions as F

from kinweave.operators import disclosure as dc

from .conftest import rows


def found(spark, names, texts):
    tokens = spark.createDataFrame([(n,) for n in names], "n string").select(F.explode(dc.name_tokens(F.col("n"))).alias("w"))
    return rows(dc.name_leaks(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", tokens, "w"), "i")


def test_names_of_several_parts_and_both_scripts(spark):
    texts = ["seen Hohwan Chun there", "CHUN, Hohwan", "Chun and Hohwan", "전호환 왔다", "전호환이", "by Ho-hwan Chun", "malice", "Alice.", None, "", "Hohwan Chunk", "a Li Wu b", "전 호환"]
    assert rows_of(found(spark, ["Hohwan Chun", "전호환", "Alice", "Li Wu"], texts)) == [0, 1, 3, 5, 7, 11, 12]


def test_short_names_stand_ins_and_urls(spark):
    texts = ["the date of it", "an unknown", "미상", "at https://x.org/date/1", "see https://x.org/kim-haneul)", "https://x.org/program/art", "https://a.b/%EC%A0%84%ED%98%B8%ED%99%98"]
    assert rows_of(found(spark, ["Date", "Unknown ", "미상", "Haneul Kim", "Mart", "김", "전호환", None, ""], texts)) == [3, 4, 6]


def test_long_texts_and_no_names(spark):
    assert rows_of(found(spark, ["Ann Maria Lee"], ["word " * 3000 + "Ann Maria Lee", "Ann"])) == [0]
    assert found(spark, ["-"], ["Ann Maria Lee"]) == []


def rows_of(got):
    return sorted(r[0] for r in got)
