import pytest
from pyspark.sql import functions as F

from kinweave.functions import chunks as ck
from kinweave.functions import venues as vn
from kinweave.operators import institutions as it
from kinweave.operators import quality as ql
from kinweave.operators import review as rv
from kinweave.serve import Bundle
from kinweave.sources import snapshot_sink

from .conftest import rows


def test_constraints_name_the_rows(spark):
    ql.require_none(spark.range(0), "fine")
    with pytest.raises(ql.ConstraintError, match="no rows"):
        ql.require_none(spark.range(3), "no rows")


def test_year_flags(spark):
    df = spark.createDataFrame([("2003", "Show 2001-2003"), ("2003", "Show 2001~03"), ("1899", "x"), ("", "x"), ("2001", "Show 2001–2003"), ("2002", None)], "y string, t string")
    assert [r[0] for r in df.select(ql.year_flags(F.col("y"), F.col("t"), 2026)).collect()] == [["Y2"], [], ["Y0"], ["Y0"], ["Y2"], []]


def test_sync_versions_and_corrections(spark):
    w = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    o = spark.createDataFrame([("b",), ("c",)], "k string")
    assert rows(rv.sync(w, o, ["k"])) == [("a", "open"), ("b", "keep"), ("c", "close")]
    empty = spark.createDataFrame([], "k string, version int, digest string")
    now = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    one = rv.version_rows(empty, now, ["k"], ["v"], F.lit("d1"))
    two = rv.version_rows(one.select("k", "version", "digest"), spark.createDataFrame([("a", "y"), ("b", None)], "k string, v string"), ["k"], ["v"], F.lit("d2"))
    assert rows(one, "k", "version") == [("a", 1), ("b", 1)] and rows(two, "k", "v", "version") == [("a", "y", 2)]
    df = spark.createDataFrame([("a", "v1", "w1"), ("b", "v2", "w2")], "k string, v string, w string")
    c = spark.createDataFrame([("a", "v", "old", 1), ("a", "v", "new", 2), ("b", "w", None, 1), ("b", "k", "no", 1)], "k string, field string, value string, at int")
    assert rows(rv.corrected(df, ["k"], c, "field", "value", ["v", "w"], "at")) == [("a", "new", "w1"), ("b", "v2", None)]


def test_paired_changes_overflow_to_the_last(spark):
    o = spark.createDataFrame([("k", f"o{i}") for i in range(4)], "k string, o string")
    n = spark.createDataFrame([("k", "n0"), ("k", "n1")], "k string, n string")
    assert rows(rv.paired_changes(o, n, ["k"], "o", "n")) == [("o0", "n0"), ("o1", "n1"), ("o2", "n1"), ("o3", "n1")]


def test_stale_and_superseded(spark):
    e = spark.createDataFrame([("d1", "s1", "x"), ("d2", "s2", "x"), ("d3", "s9", "x")], "d string, s string, h string")
    s = spark.createDataFrame([("s1", "x"), ("s2", "y")], "s string, h string")
    assert rows(rv.stale(e, s, "d", "s", "h")) == [("d2",), ("d3",)]
    r = spark.createDataFrame([("k", "pub"), ("k", "self"), ("m", "self"), (None, "self")], "k string, o string")
    assert sorted(x["superseded"] for x in rv.superseded(r, ["k"], "o", "pub").collect()) == [False, False, False, True]
    n = spark.createDataFrame([("a; rule=E1; b",), (None,)], "c string")
    assert [x[0] for x in n.select(rv.without_mark(F.col("c"), "rule")).collect()] == ["a; b", ""]


def test_venue_parts_kinds_and_keys(spark):
    df = spark.createDataFrame([("The Foo Hall (Town), KR",), ("Town - New Gallery | B",), (None,), ("",)], "v string")
    got = [r[0] for r in df.select(vn.fragments(F.col("v"))).collect()]
    assert got == [["The Foo Hall", "Town", "KR"], ["Town", "New Gallery", "B"], None, []]
    assert rows(df.select(vn.kind_of(F.col("v")).alias("k"))) == [("",), ("",), ("gallery",), ("stage",)]
    k = spark.createDataFrame([("New Gallery", "Town"), ("Gallery New", "town"), ("Foo Gallery", "Town"), ("MMA", "x")], "n string, p string")
    keys = [r[0] for r in k.select(vn.entity_key(F.col("n"), F.col("p"))).collect()]
    assert keys[0] == keys[1] == "gallery new@town" and keys[2] == "foo gallery"
    assert k.filter(vn.acronym_fits(F.col("n"), F.lit("Museum of Modern Art"))).count() == 1


def test_guarded_components_keep_two_readings_apart(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "s string, t string")
    lab = spark.createDataFrame([("a", "1"), ("c", "2"), ("x", "1"), ("y", None)], "k string, l string")
    merged, blocked = it.guarded_components(e, "s", "t", lab, "k", "l")
    assert rows(merged) == [("x", "x"), ("y", "x")] and rows(blocked, "id") == [("a",), ("b",), ("c",)]


def test_votes_and_elections(spark):
    v = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", None), ("h", "a"), ("h", "b"), ("i", None)], "g string, v string")
    assert rows(it.majority(v, "g", "v")) == [("g", "a"), ("h", "a")]
    assert rows(it.unanimous(v, "g", "v", 2)) == [("g", "a")]
    n = spark.createDataFrame([("g", "ab"), ("g", "abc"), ("g", "abc"), ("h", "x")], "g string, n string")
    assert rows(it.elected_names(n, "g", "n")) == [("g", "abc", 3, 2), ("h", "x", 1, 1)]
    num = it.numbered(n.select("n").distinct().repartition(3), [F.col("n")], "n", "V-", 3)
    assert rows(num) == [("ab", "V-001"), ("abc", "V-002"), ("x", "V-003")]


def test_grounding(spark):
    df = spark.createDataFrame([("In 2017, at the Foo-Hall.", "Show", "Foo Hall", "2017"), ("In 12017", "Big Show", "", "2017"), ("big show", "Big: Show", None, None)], "x string, t string, v string, y string")
    assert [r[0] for r in df.select(ck.failures(F.col("x"), F.col("t"), F.col("v"), F.col("y"))).collect()] == [[], ["year", "title"], []]
    r = spark.createDataFrame([("1", "e", "Red Sea"), ("2", "e", "red moon"), ("3", "none", "x"), ("4", "e", None)], "i string, e string, t string")
    docs = spark.createDataFrame([("e", "a RED"), ("e", "sea.")], "e string, x string")
    assert rows(ql.missing_words(r, docs, "i", "e", "t", "x")) == [("2", 2, 1)]


def test_pieces_hold_every_word(spark):
    text = "Head:\nfirst line\n\n" + "\n".join(f"line {i}" for i in range(400)) + "\n\n" + "x" * 2500
    out = ck.pieces(text, 1000)
    assert max(map(len, out)) <= 1000 and all(f"line {i}" in "\n".join(out) for i in range(400)) and sum(p.count("x") for p in out) == 2500
    assert ck.pieces("") == [] and ck.pieces("one") == ["one"]
    got = spark.createDataFrame([(None,), ("",), ("a b",)], "t string").select(ck.split_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, [], ["a b"]]


def test_lookups_and_their_contract(spark):
    b = Bundle({"rates": spark.createDataFrame([("0-2", 50, 0.5), ("3-5", None, None), ("6+", 12, 0.1)], "band string, n int, share double")}, routes=[("next", "next|다음")])
    assert rows(b.rows("rates", band="0-2").select("band", "contract.may_generalise", "contract.suppressed")) == [("0-2", True, False)]
    assert b.withheld() == {"rates": 1} and b.vocabulary("rates", "band") == ["0-2", "3-5", "6+"] and b.route("What NEXT?") == "next"
    assert b.either("rates", ["band"], "6+").count() == 1
    with pytest.raises(KeyError):
        b.rows("rates", colour="red")


def test_a_version_is_published_once_and_whole(spark, tmp_path):
    root, df = str(tmp_path / "out"), spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    m = snapshot_sink.publish(spark, root, "v1", {"t": df, "j": df.limit(0)})
    again = snapshot_sink.publish(spark, root, "v2", {"t": df.orderBy(F.desc("k")), "j": df.limit(0)})
    assert m["tables"]["t"] == again["tables"]["t"] and m["tables"]["j"]["rows"] == 0 and snapshot_sink.versions(spark, root) == ["v1", "v2"]
    with pytest.raises(FileExistsError):
        snapshot_sink.publish(spark, root, "v1", {"t": df})
