from pyspark.sql import functions as F

from kinweave.functions import dates, stats
from kinweave.operators import cohorts as ch

from .conftest import rows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_censoring(spark):
    lit = F.lit
    assert one(spark, dates.reached(lit(2000), 10, 2010)) and not one(spark, dates.reached(lit(2000), 11, 2010))
    assert one(spark, dates.window_open(lit(2000), 10, 2013)) and not one(spark, dates.window_open(lit(2000), 10, 2012))


def test_quantile_gate(spark):
    allowed = lambda n, q: one(spark, stats.quantile_allowed(F.lit(n), q))
    assert [allowed(19, 0.5), allowed(20, 0.5), allowed(39, 0.25), allowed(40, 0.25), allowed(39, 0.75), allowed(40, 0.75), allowed(99, 0.1), allowed(100, 0.1)] == [False, True] * 4


def test_share_gate_and_rounding(spark):
    assert one(spark, stats.gate_share(F.lit(0.5), F.lit(19))) is None and one(spark, stats.gate_share(F.lit(0.5), F.lit(20))) == 0.5
    assert [one(spark, stats.round_to_5(F.lit(n))) for n in (0, 2, 3, 7, 8)] == [0, 0, 5, 5, 10]
    assert [one(spark, dates.generation_of(F.lit(y))) for y in (1999, 2000, 2004, 2005)] == [1995, 2000, 2000, 2005]
    assert [one(spark, dates.band_of(F.lit(a))) for a in (0, 3, 10, 21)] == ["0-2", "3-5", "6-10", "21+"]


def test_mix_bucket(spark):
    mix = lambda a, b, c, n=10: one(spark, ch.mix_bucket({"exhibition": F.lit(a), "stage": F.lit(b), "other": F.lit(c)}, F.lit(n)))
    assert mix(0.4, 0.4, 0.2) == "mixed" and mix(0.6, 0.6, 0.0) == "exhibition" and mix(0.0, 0.0, 0.0, 0) == "none"


def test_empty_windows_are_no_zero(spark):
    data = [(f"p{i}", 2003) for i in range(20)] + [(f"p{i}", 2006) for i in range(20)]
    df = spark.createDataFrame(data, "p string, y int")
    got = rows(ch.age_grid(df, "p", "y", F.count(F.lit(1)), [0, 3], 2020).groupBy("age").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")))
    assert got == [(0, 20, 20), (3, 20, 40)]


def test_next_window_counts_once_and_censors(spark):
    data = [(f"p{i}", y, k) for i in range(30) for y, k in ((2000, "a"), (2002, "solo"))] + [("late", 2024, "a")]
    df = spark.createDataFrame(data, "p string, y int, k string")
    r = ch.next_window(df, "p", "y", F.col("k") == "solo", [0], 2025).first()
    assert (r["n"], r["censored"], r["share"], r["status"]) == (30, 1, 1.0, "published") and r["hi"] == 1.0
    small = ch.next_window(df.filter("p < 'p13'"), "p", "y", F.col("k") == "solo", [0], 2025).first()
    assert small["n"] is None and small["share"] is None and small["status"] == "suppressed"


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 1.0), ("g", 3, 2.0), ("g", None, 9.0)], "g string, v int, w double")
    assert rows(ch.weighted_quantiles(df, ["g"], "v", "w", [0.25, 0.5, 0.75])) == [("g", 0.25, 1), ("g", 0.5, 2), ("g", 0.75, 3)]


def test_transitions_include_zero_pairs(spark):
    df = spark.createDataFrame([("a", "X", 2000), ("a", "Y", 2003), ("b", "X", 2001), ("c", None, 2001), ("d", "Y", None)], "p string, c string, y int")
    assert rows(ch.transitions(df, "p", "c", "y", 2020)) == [("X", "Y", 2, 1, 3.0), ("Y", "X", 1, 0, None)]


def test_dominant_and_tied_values(spark):
    df = spark.createDataFrame([("g", "a")] * 9 + [("g", "b")] + [("h", "a"), ("h", "b")], "g string, v string")
    assert rows(ch.dominant(df, ["g"], "v")) == [("g", "a", 0.9), ("h", None, 0.5)]
    assert rows(ch.unique_top(df, ["g"], "v")) == [("g", "a"), ("h", None)]


def test_compare_is_a_full_outer_join(spark):
    p = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    o = spark.createDataFrame([("b", 2.5), ("c", 1.0)], "k string, v double")
    assert rows(ch.compare(p, o, ["k"], "v")) == [(1, 1, 1, 0.5, 0.5)]


def test_wilson_bounds(spark):
    lo, hi = stats.wilson(F.lit(143), F.lit(147))
    assert (round(one(spark, lo), 3), round(one(spark, hi), 3)) == (0.932, 0.989)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None
