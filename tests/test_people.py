from pyspark.sql import functions as F

from kinweave.functions import people as pe
from kinweave.functions import vectors as vc
from kinweave.functions.stats import cosine


def test_identities_and_names(spark):
    df = spark.createDataFrame([("identity=wd:1; x", "identity=wd:2"), ("identity=wd:1", "identity=ab:2"), ("identity=wd:1; identity=wd:9", "y; identity=wd:1"), (None, "identity=wd:1")], "a string, b string")
    assert [r[0] for r in df.select(pe.pinned_apart(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    n = spark.createDataFrame([("김 유환", None, "김유환", None), (None, "Lee Ann", None, "ann LEE"), ("김유환", "Ann Lee", "이유환", "Lee Ann"), (None, "Ann", None, "Ann")], "ak string, ae string, bk string, be string")
    assert [r[0] for r in n.select(pe.names_meet(*map(F.col, ("ak", "ae", "bk", "be")))).collect()] == [True, True, False, False]


def test_same_activity_needs_length(spark):
    df = spark.createDataFrame([(2000, "The Red Sea", 2000, "red sea"), (2000, "The Red", 2000, "red"), (2000, "Sea", 2001, "Sea"), (2000, "sea!", 2000, "Sea"), (2000, "붉은 바다와 산", 2000, "붉은바다"), (2000, "", 2000, "")], "y int, a string, z int, b string")
    assert [r[0] for r in df.select(pe.same_activity(F.col("y"), F.col("a"), F.col("z"), F.col("b"))).collect()] == [True, False, False, True, True, False]


def test_names_in_urls(spark):
    df = spark.createDataFrame([("https://a.org/ann-lee%20x", ["annlee"]), ("https://a.org/x", ["lee"]), ("bad%zz", ["bad"])], "u string, t array<string>")
    assert [bool(r[0]) for r in df.select(pe.url_embeds_name(F.col("u"), F.col("t"))).collect()] == [True, False, False]


def test_hashed_vectors(spark):
    assert vc.fnv1a("") == 0x811C9DC5 and vc.fnv1a("a") == 0xE40C292C
    df = spark.createDataFrame([("red sea",), ("Red, SEA!",), ("other words here",), (None,)], "t string").withColumn("v", vc.text_vector(F.col("t")))
    q = F.array(*map(F.lit, vc.hashed("red sea")))
    got = [r[0] for r in df.select(cosine(F.col("v"), q)).collect()]
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 1) < 1e-9 and got[2] < 0.6 and got[3] == 0
