import itertools
import random

from pyspark.sql import functions as F

from kinweave.operators import copresence as co
from kinweave.operators import partitions as pt

from .conftest import rows


def members(spark, groups):
    data = [(v, y, p) for (v, y), ps in groups.items() for p in ps]
    df = spark.createDataFrame(data, "venue string, year int, person string")
    return co.presences(df, "person", [F.col("venue"), F.col("year")], F.lit(True))


def test_pairs_of_groups(spark):
    m = members(spark, {("V", 2020): ["b", "a"], ("V", 2021): ["a", "b", "c"], ("W", 2020): ["z"]})
    assert rows(co.pairs_of(m)) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_large_groups_are_cut_into_blocks(spark):
    random.seed(1)
    groups = {(f"v{i}", 2000): [f"p{random.randrange(60):02d}" for _ in range(40)] for i in range(4)}
    want = {p for ps in groups.values() for p in itertools.combinations(sorted(set(ps)), 2)}
    got = co.pairs_of(members(spark, groups), block=7)
    assert rows(got) == sorted(want)


def test_presences_leave_out_null_keys(spark):
    df = spark.createDataFrame([("v", None, "a"), (None, 1, "a"), ("v", 1, None), ("v", 1, "a"), ("v", 1, "a")], "venue string, year int, person string")
    assert co.presences(df, "person", [F.col("venue"), F.col("year")], F.lit(True)).count() == 1
    assert co.pairs_of(co.presences(df.limit(0), "person", [F.col("venue")], F.lit(True))).count() == 0


def test_layers_count_a_pair_once(spark):
    df = spark.createDataFrame([("Hall", "a"), ("hall", "b"), ("Hall", "c")], "venue string, person string")
    got = rows(co.layers(df, "person", F.lit(True), {"typed": [F.col("venue")], "lower": [F.lower("venue")]}))
    assert got == [("lower", 3, 2), ("typed", 1, 1)]


def test_lift_and_auc_of_blocks(spark):
    a = spark.createDataFrame([(str(i), "A" if i < 3 else "B") for i in range(6)], "e string, g string")
    t = spark.createDataFrame([("0", "1"), ("0", "2"), ("3", "4")], "src string, dst string")
    r = pt.lift_auc(a, "e", "g", t).first()
    assert (r["lift"], r["auc"]) == (2.5, 0.875)
    none = pt.lift_auc(a, "e", "g", t.limit(0)).first()
    assert none["lift"] is None and none["auc"] is None


def ari(spark, left, right):
    df = spark.createDataFrame(list(zip(left, right)), "l int, r int")
    return pt.adjusted_rand(df, "l", "r").first()["ari"]


def test_adjusted_rand(spark):
    assert ari(spark, [0, 0, 1, 1], [0, 0, 1, 1]) == 1
    assert ari(spark, [0, 0, 1, 1], [1, 1, 0, 0]) == 1
    assert ari(spark, [0, 0, 1, 1], [0, 0, 0, 0]) == 0
    assert ari(spark, [0, 0, 1, 1], [0, 1, 0, 1]) == -0.5
    assert ari(spark, [0, 0, 0, 0], [1, 1, 1, 1]) == 1
    assert abs(ari(spark, [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1]) - 0.32432432432432434) < 1e-8


def test_coverage(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "y")], "e string, g string")
    r = pt.coverage(df, "e", "g").first()
    assert (r["entities"], r["placed"], r["share"], r["groups"], r["singletons"]) == (4, 3, 0.75, 2, 1)


def test_bootstrap_interval_holds_the_mean_and_is_repeatable(spark):
    df = spark.createDataFrame([("g", f"e{i}", float(i % 10)) for i in range(200)], "g string, e string, v double")
    a, b = (pt.bootstrap_mean(df.repartition(n), "e", "v", ["g"], draws=50).first() for n in (1, 3))
    assert a["lo"] <= a["mean"] <= a["hi"] and abs(a["lo"] - b["lo"]) < 1e-9 and a["hi"] - a["lo"] < 1.5
