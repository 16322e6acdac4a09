import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import copresence as co
from kinweave.operators import partitions as pt
from kinweave.operators.dense_pairs import Members
from kinweave.storage import Scratch

from .conftest import rows


def drawn(spark, kind="string"):
    """Members of twelve overlapping groups and of one with a single member."""
    rng = random.Random(1)
    name = (lambda k: f"é{k}" if k % 3 else f"z{k}") if kind == "string" else (lambda k: 7 * k - 100)
    data = [(f"v{i}", name(rng.randrange(160))) for i in range(12) for _ in range(20)] + [("solo", name(500))]
    return co.presences(spark.createDataFrame(data, f"venue string, person {kind}"), "person", [F.col("venue")], F.lit(True))


def wanted(members):
    groups = {}
    for r in members.collect():
        groups.setdefault(r["grp"], set()).add(r["entity"])
    return sorted({p for ps in groups.values() for p in itertools.combinations(sorted(ps), 2)}, key=repr)


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_pairs_as_bits_whatever_the_cut(spark, kind):
    m = drawn(spark, kind)
    for size, part_rows in ((4096, 10**6), (12, 5)):
        assert rows(Members(m, m.count(), size, part_rows).pairs()) == wanted(m)


def test_repeated_pairs_are_not_shuffled(spark):
    df = spark.range(60).crossJoin(spark.range(40).withColumnRenamed("id", "g"))
    got = co.pairs_of(co.presences(df, "id", [F.col("g")], F.lit(True)), listed=1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "src" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert rows(got) == sorted(itertools.combinations(range(60), 2), key=repr)


def test_degrees_without_listing_pairs(spark):
    m = drawn(spark)
    want = rows(co.degrees(co.pairs_of(m)))
    assert rows(co.degrees_of(m)) == want
    got = Members(m, m.count(), 12, 5).degrees()
    assert rows(got) == want and "Generate explode(dsts" not in got._jdf.queryExecution().toString()


def people(spark, m):
    """Some of the members, some unplaced or twice, and two that are no members."""
    rng = random.Random(2)
    ids = sorted({r["entity"] for r in m.collect()})
    data = [(x, rng.choice("ABC")) for x in ids if x[-1] != "7"] + [(ids[0], "A"), (ids[1], "B"), (ids[2], None), ("other", "A"), ("another", "C")]
    return spark.createDataFrame(data, "e string, g string")


def test_lift_without_listing_pairs(spark):
    m = drawn(spark)
    p = people(spark, m)
    want = pt.lift_auc(p, "e", "g", co.pairs_of(m)).first()
    assert want["inside"] > 0 and pt.copresent_lift(p, "e", "g", m).first() == want
    got = pt.copresent_lift(p, "e", "g", m, listed=0)
    assert got.first() == want and "Generate explode(dsts" not in got._jdf.queryExecution().toString()
    assert pt.copresent_lift(p.limit(0), "e", "g", m, listed=0).first() == pt.lift_auc(p.limit(0), "e", "g", co.pairs_of(m)).first()


def test_intervals_without_drawing_before_the_ties_are_met(spark):
    m = drawn(spark)
    p, ties = people(spark, m), co.pairs_of(m)
    every = p.filter("g IS NOT NULL").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("n", pt.poisson_count(1, F.col("draw"), F.col("e")))
    want = rows(pt.counted_scores(every, "e", "g", "n", ties, ["draw"]), "draw", "pairs", "ties", "inside")
    dense = Members(m, m.count(), 12, 5)
    counts = p.filter("g IS NOT NULL").select(F.col("e").alias("entity"), F.col("g").alias("label"), F.array(*[pt.poisson_count(1, F.lit(k), F.col("e")) for k in range(1, 21)]).alias("counts"))
    assert rows(dense.tied(counts).select("draw", F.col("t").cast("long"), F.col("s").cast("long"))) == [(d, t, s) for d, _, t, s in want]
    plain = pt.score_intervals(p, "e", "g", ties, draws=20)
    assert plain.first() == pt.copresent_intervals(p, "e", "g", m, draws=20, listed=0).first() and plain.first()["defined"] == 20


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString().splitlines()


def test_people_are_not_broadcast_to_their_ties(spark, monkeypatch, tmp_path):
    m = drawn(spark)
    people(spark, m).write.parquet(f"{tmp_path}/people")
    p = spark.read.parquet(f"{tmp_path}/people")  # of a known, small size
    ties = spark.createDataFrame(wanted(m), "src string, dst string")
    plan = plan_of(pt.score_intervals(p, "e", "g", ties, draws=20))
    assert all("[draw#" in x for x in plan if "BroadcastHashJoin" in x) and sum("SortMergeJoin [src#" in x or "SortMergeJoin [dst#" in x for x in plan) == 2
    saved, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.update({name: plan_of(df)}) or save(self, df, name))
    pt.copresent_intervals(p, "e", "g", m, draws=20, listed=0)
    plan = saved["parts"]
    at = next(k for k, x in enumerate(plan) if "SortMergeJoin [" in x)
    assert not any("BroadcastHashJoin" in x for x in plan)
    # counts are made of those that have a group only: above the join
    assert [k < at for k, x in enumerate(plan) if "transform(" in x] == [True]


def test_counts_go_packed_to_the_cells(spark):
    m = drawn(spark)
    dense = Members(m, m.count(), 12, 5)
    counts = people(spark, m).filter("g IS NOT NULL").select(F.col("e").alias("entity"), F.col("g").alias("label"))
    got = dense.tied(counts, F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: pt.poisson_count(1, k, F.col("entity")).cast("tinyint")))
    assert got.count() == 20 and dict(dense.work.read("parts").dtypes)["counts"] == "binary"


def test_pairs_among_some_are_pairs_of_some_members(spark):
    m = drawn(spark)
    some = people(spark, m)
    assert rows(co.pairs_of(co.among(m, some, "e"))) == rows(co.limited(co.pairs_of(m), some, "e"))
