import random

from pyspark.sql import functions as F

from kinweave.operators import components as cc
from kinweave.operators import linkage as ln
from kinweave.operators import merge as mg
from kinweave.operators import sequences as sq
from kinweave.operators.joins import hot_keys, skew_left_join

from .conftest import rows


def roots(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in up)


def test_components_against_union_find(spark):
    random.seed(2)
    pairs = [(f"n{random.randrange(80):02d}", f"n{random.randrange(80):02d}") for _ in range(60)] + [(None, "n01"), ("n02", "n02")] + [(f"q{i:02d}", f"q{i + 1:02d}") for i in range(30)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert rows(cc.components(df, "a", "b")) == roots(pairs)
    assert cc.components(df.limit(0), "a", "b").count() == 0


def test_redirect_chains_end_at_the_survivor(spark):
    df = spark.createDataFrame([(f"r{i:02d}", f"r{i + 1:02d}") for i in range(20)] + [("x", "x")], "old string, new string")
    assert rows(cc.follow(df, "old", "new")) == [(f"r{i:02d}", "r20") for i in range(20)]
    tails = spark.createDataFrame([("1", "5"), ("5", "6"), ("6", "5"), ("2", "1"), ("3", "4"), ("7", "8"), ("8", "9"), ("9", "7"), ("0", "9")], "old string, new string")
    assert rows(cc.follow(tails, "old", "new")) == [("0", "7"), ("1", "5"), ("2", "5"), ("3", "4"), ("5", "5"), ("6", "5"), ("7", "7"), ("8", "7"), ("9", "7")]


def test_upsert_fills_only_blanks_and_is_idempotent(spark):
    t = spark.createDataFrame([("1", "a", ""), ("2", None, "x")], "k string, v string, w string")
    n = spark.createDataFrame([("1", "b", "q"), ("2", "c", None), ("3", "d", "e"), ("3", "", "f")], "k string, v string, w string")
    once = mg.upsert(t, n, ["k"], ["v", "w"])
    assert rows(once) == [("1", "a", "q", "matched"), ("2", "c", "x", "matched"), ("3", "d", "e", "added")]
    assert rows(mg.upsert(once.drop("how"), n, ["k"], ["v", "w"]), "k", "v", "w") == rows(once, "k", "v", "w")


def test_tiers_first_and_latest(spark):
    left = spark.createDataFrame([("l1", "a", "x"), ("l2", "b", "y"), ("l3", "c", "z")], "l string, p string, q string")
    right = spark.createDataFrame([("r2", "a", "x"), ("r1", "a", "x"), ("r3", "n", "y")], "r string, p string, q string")
    assert rows(mg.tiered_match(left, right, "l", "r", [("both", ["p", "q"]), ("q", ["q"])])) == [("l1", "r1", "both"), ("l2", "r3", "q")]
    v = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("k", None, "none")], "k string, t int, v string")
    assert rows(mg.latest(v, ["k"], [F.col("t")], ["v"])) == [("k", "new")]


def test_mutual_unique_pairs(spark):
    a = spark.createDataFrame([("a1", 1), ("a2", 2), ("a3", 2)], "a string, k int")
    b = spark.createDataFrame([("b1", 1), ("b2", 2)], "b string, k int")
    assert rows(mg.mutual_unique(a, b, "a", "b", ["k"])) == [("a1", "b1")]


def test_ids_follow_the_highest_ever_issued(spark):
    new = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "k string").repartition(4)
    old = spark.createDataFrame([(7,), (3,)], "n int")
    got = rows(mg.allocate_ids(new, old, "n", ["k"], "GY-"))
    assert got == [(f"n{i:03d}", f"GY-{8 + i:06d}") for i in range(50)]
    assert rows(mg.missing_numbers(spark.createDataFrame([(1,), (2,), (5,), (250_000,)], "n int"), "n")) == [(2, 2), (5, 249_994)]


def test_runs_bands_prefixes(spark):
    e = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, None), ("u", 5, None), ("u", 6, "a")], "u string, t int, v string")
    assert rows(sq.runs(e, ["u"], ["t"], "v")) == sorted([("u", "a", 1, 2), ("u", "b", 3, 1), ("u", None, 4, 2), ("u", "a", 6, 1)], key=repr)
    a = spark.createDataFrame([("k", i) for i in range(-3, 10, 3)], "k string, x int")
    b = spark.createDataFrame([("k", i) for i in range(-4, 11, 2)], "k string, y int")
    want = sorted((x, y) for x in range(-3, 10, 3) for y in range(-4, 11, 2) if abs(x - y) <= 1)
    assert sorted((r["x"], r["y"]) for r in sq.band_join(a, b, ["k"], "x", "y", 1).collect()) == want
    codes = spark.createDataFrame([("ABC-1",), ("AX",), ("",), (None,)], "c string")
    p = spark.createDataFrame([("A",), ("ABC",)], "p string")
    assert rows(sq.longest_prefix(codes, "c", p, "p", 3)) == sorted([("ABC-1", "ABC"), ("AX", "A"), ("", None), (None, None)], key=repr)


def test_skewed_join_keeps_every_row(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)] + [(None, -1)], "k string, i int")
    small = spark.createDataFrame([("hot", "H")] + [(f"k{i}", "C") for i in range(0, 50, 2)], "k string, v string")
    got = skew_left_join(big, small, "k", hot_keys(big, "k", 0.1))
    assert got.count() == 551 and got.filter("v = 'H'").count() == 500 and got.filter("v IS NULL").count() == 26


def test_evidence_gates_merging(spark):
    c = spark.createDataFrame([("b", "a"), ("a", "c"), ("d", "e")], "src string, dst string")
    e1 = spark.createDataFrame([("a", "b", "E1", "site")], "src string, dst string, rule string, evidence string")
    e2 = spark.createDataFrame([("a", "b", "E2", "line"), ("d", "e", "E2", "line")], "src string, dst string, rule string, evidence string")
    merges, queue = ln.gated(c, [e1, e2], spark.createDataFrame([("e", "d")], "src string, dst string"))
    assert rows(merges) == [("a", "b", "E1", "site")] and rows(queue) == [("a", "c")]
    n = spark.createDataFrame([("a", 1), ("b", 5)], "id string, n int")
    red = ln.survivors(n, "id", "n", merges)
    assert rows(red) == [("a", "b")]
    child = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "id string, x int")
    assert rows(ln.repointed(child, "id", red), "id", "x") == sorted([("b", 1), ("z", 2), (None, 3)], key=repr)


def test_match_weights_separate_agreeing_pairs(spark):
    data = [(i, 1, 1) for i in range(30)] + [(i, 0, 0) for i in range(30, 300)] + [(i, 0, 1) for i in range(300, 330)]
    df = spark.createDataFrame(data, "id int, x int, y int")
    got = {r["id"]: r["probability"] for r in ln.match_weights(df, {"x": F.col("x"), "y": F.col("y")}).collect()}
    assert len(got) == 330 and got[0] > 0.9 and got[40] < 0.1
    assert ln.match_weights(df.limit(0), {"x": F.col("x")}).count() == 0
