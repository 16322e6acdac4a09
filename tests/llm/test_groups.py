import random

from kinweave.llm.groups import match_groups

from ..conftest import rows
from ..test_records import roots

COLS = "kept string, dropped string, v string, a string, group_id string"


def groups(spark, pairs, **kw):
    df = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in pairs], COLS)
    return rows(match_groups(df, "kept", "dropped", "ledger_id", "group_id", **kw))


def test_paths_cycles_and_stars(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    cycle = [(f"c{i:02d}", f"c{(i + 1) % 40:02d}") for i in range(40)]
    star = [("hub", f"s{i:03d}") for i in range(150)]
    pairs = path + cycle + star
    random.seed(3)
    random.shuffle(pairs)
    assert groups(spark, pairs) == roots(pairs)


def test_dense_core_with_tails(spark):
    random.seed(4)
    pairs = [(f"d{random.randrange(40):02d}", f"d{random.randrange(40):02d}") for _ in range(200)] + [("d01", "t1"), ("t1", "t2"), ("x", "y")]
    assert groups(spark, pairs) == roots(pairs)
    # the same core too large for one task, with its hub too large for one key
    assert groups(spark, pairs, core_edges=10) == roots(pairs)


def test_a_hub_of_many_leaves(spark, monkeypatch):
    monkeypatch.setattr("kinweave.operators.joins.MANY", 5)
    pairs = [("hub", f"s{i:05d}") for i in range(3000)] + [(f"s{i:05d}", f"s{i + 1:05d}") for i in range(0, 2000, 3)]
    assert groups(spark, pairs) == roots(pairs)


def test_rows_that_link_nothing(spark):
    pairs = [(None, "a"), ("b", None), ("c", "c"), (None, None), ("k", "m"), ("m", "k"), ("k", "m"), ("k", "k")]
    assert groups(spark, pairs) == [("k", "k"), ("m", "k")]


def test_empty_table(spark):
    assert groups(spark, []) == [] and groups(spark, [(None, "a")]) == []
