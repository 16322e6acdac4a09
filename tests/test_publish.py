from pyspark.sql import functions as F

from kinweave.operators import disclosure as dc
from kinweave.operators import sampling as sm
from kinweave.operators import search as se

from .conftest import rows


def status(spark, data, margins):
    df = spark.createDataFrame(data, "r string, c string, n int").withColumn("status", dc.primary(F.col("n")))
    return {(x["r"], x["c"]): x["status"] for x in dc.secondary(df, margins, ["r", "c"], "n", "status").collect()}


def test_a_lone_withheld_cell_takes_another_with_it(spark):
    got = status(spark, [("t", "a", 3), ("t", "b", 12)], [["r"]])
    assert got == {("t", "a"): "suppressed", ("t", "b"): "secondary"}


def test_secondary_suppression_protects_both_margins(spark):
    data = [(r, c, n) for r, ns in {"x": (3, 20, 30), "y": (15, 25, 40), "z": (18, 22, 50)}.items() for c, n in zip("abc", ns)]
    got = status(spark, data, [["r"], ["c"]])
    for axis in (0, 1):
        for v in {k[axis] for k in got}:
            assert sum(s != "published" for k, s in got.items() if k[axis] == v) != 1
    assert got[("x", "a")] == "suppressed" and "published" in got.values()


def test_dominance_prints_a_bound(spark):
    df = spark.createDataFrame([("g", "a", 95), ("g", "b", 5), ("h", "a", 50), ("h", "b", 50)], "g string, c string, n int").withColumn("status", F.lit("published"))
    assert rows(dc.with_dominance(df, ["g"], "n", "status"), "g", "c", "status") == [("g", "a", "bound"), ("g", "b", "suppressed"), ("h", "a", "published"), ("h", "b", "published")]


def test_differencing_and_leaks(spark):
    p = spark.createDataFrame([("a", 12), ("b", 20)], "k string, n int")
    q = spark.createDataFrame([("a", 10), ("b", 5)], "k string, n int")
    assert rows(dc.differencing(p, q, ["k"], "n", 3)) == [("a", 2)]
    t = spark.createDataFrame([(1, "seen Alice there"), (2, "malice"), (3, None)], "i int, t string")
    assert rows(dc.leaks(t, "t", spark.createDataFrame([("alice",)], "w string"), "w"), "i") == [(1,)]


def test_hamilton_quotas_sum_up(spark):
    z = spark.createDataFrame([("a", 50), ("b", 30), ("c", 21)], "s string, z int")
    got = dict(rows(sm.hamilton(z, "s", "z", 10)))
    assert sum(got.values()) == 10 and got["a"] == 5
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in (("a", 50), ("b", 30), ("c", 21)) for i in range(n)], "k string, s string")
    q = sm.hamilton(z, "s", "z", 10)
    one, two = (rows(sm.stratified_sample(df.repartition(n), "s", "k", q, 5)) for n in (1, 4))
    assert one == two and len(one) == 10


def test_search_scores(spark):
    df = spark.createDataFrame([(1, "Art Center", None), (2, "Art Center North", ""), (3, "The Artcenter", "x"), (4, "Art of Center", "x"), (5, "Nothing", "x")], "i int, title string, venue string")
    got = {r["i"]: r["score"] for r in se.scored_search(df, "Art Center", {"title": 2.0, "venue": 1.5}, ["i"]).collect()}
    assert got == {1: 16.0, 2: 12.0, 3: 10.0, 4: 4.0}


def test_shelves_and_masks(spark):
    df = spark.createDataFrame([("a", ["x", "x"]), ("b", None), ("c", ["x", "y"])], "e string, t array<string>")
    assert rows(se.shelves(df, F.col("t"))) == [("other", 1), ("x", 2), ("y", 1)]
    v = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "w"), ("d", None)], "e string, v string")
    assert rows(se.shared_only(v, "v", "e"), "e", "v") == [("a", "v"), ("b", "v"), ("c", None), ("d", None)]


def test_nearest_vectors_and_zero_norm(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "i int, v array<double>")
    assert [(r["i"], r["score"]) for r in se.nearest(df, "v", [2.0, 0.0], ["i"], 3).collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]
