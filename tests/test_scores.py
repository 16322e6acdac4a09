from pyspark.sql import functions as F

from kinweave.operators import disclosure as dc
from kinweave.operators import partitions as pt

from .conftest import rows


def test_scores_of_counted_entities(spark):
    people = spark.createDataFrame([(i, i // 3, c) for i, c in enumerate((1, 1, 1, 1, 1, 1))] + [(9, None, 1)], "e int, g int, c int")
    ties = spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "src int, dst int")
    got = pt.counted_scores(people, "e", "g", "c", ties).first()
    assert (got["pairs"], got["ties"], got["inside"], got["lift"], got["auc"]) == (15, 3, 3, 2.5, 0.875)
    twice = pt.counted_scores(people.withColumn("c", F.when(F.col("e") == 0, 2).otherwise(F.col("c"))), "e", "g", "c", ties).first()
    assert (twice["pairs"], twice["ties"], twice["inside"]) == (20, 5, 5)
    assert pt.counted_scores(people, "e", "g", "c", ties.limit(0)).first()["lift"] is None


def test_intervals_hold_the_score_and_do_not_depend_on_partitions(spark):
    people = spark.createDataFrame([(i, i % 4) for i in range(60)], "e int, g int")
    ties = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60) if i % 4 == j % 4 and (i + j) % 3 == 0 or (i * j) % 17 == 1], "src int, dst int")
    a, b = (pt.score_intervals(people.repartition(n), "e", "g", ties.repartition(n), draws=60).first() for n in (1, 5))
    point = pt.lift_auc(people, "e", "g", ties).first()
    assert a == b and a["defined"] == 60 and a["lift_lo"] < point["lift"] < a["lift_hi"] and a["auc_lo"] < point["auc"] < a["auc_hi"]


def test_stability(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3 if i % 5 else 9) for i in range(90)] + [(99, None, 1)], "e int, l int, r int")
    same = pt.stability(df, "e", "l", "l", draws=30).first()
    assert (same["draws"], same["ari"], same["ari_lo"]) == (30, 1.0, 1.0) and 0.3 < same["left_out"] < 0.45
    other = pt.stability(df, "e", "l", "r", draws=30).first()
    assert 0.3 < other["ari_lo"] <= other["ari"] <= other["ari_hi"] < 1


def test_shares_and_margins(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 5), ("b", "y", 50), ("c", "x", 95), ("c", "y", 5)], "g string, k string, n long")
    cells = df.withColumn("status", dc.primary(F.col("n")))
    assert rows(dc.shares(cells, ["g"], "n", "status"), "g", "k", "share") == [("a", "x", "25"), ("a", "y", "75"), ("b", "x", "suppressed"), ("b", "y", "suppressed"), ("c", "x", "suppressed"), ("c", "y", "suppressed")]
    assert rows(dc.full_shares(df, ["g"], "n").filter("g = 'c'"), "k", "share") == [("x", ">=90"), ("y", "5")]
    assert rows(dc.unequal_margins(df, df.filter("n > 5"), "n", ["g"])) == [("b", 55, 50), ("c", 100, 95)]
    assert dc.unequal_margins(df, df, "n", ["g"]).count() == 0


def test_unsafe_cells(spark):
    df = spark.createDataFrame([("ok", "10", "15"), ("a@b.org", "5", "suppressed"), ("GY-000012", "suppressed", "7")], "label string, n_people string, n string")
    got = set(rows(dc.unsafe_cells(df, "n_people", ["n"])))
    assert got == {("identifier value", "label", "a@b.org"), ("identifier value", "label", "GY-000012"), ("under k", "n_people", "5"), ("not rounded", "n", "7")}
    assert ("identifier column", "name_ko", None) in rows(dc.unsafe_cells(df.withColumn("name_ko", F.lit("x")), "n_people", ["n"]))
