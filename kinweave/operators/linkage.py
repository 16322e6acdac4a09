"""Evidence-gated merging of records: blocking keys, evidence rules, survivors, and probabilistic linkage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .components import components
from .copresence import pairs_of
from .joins import hot_keys, hub_join, skew_left_join


def key_stars(df: DataFrame, record: str, keys: Column, rule: str) -> DataFrame:
    """(src, dst, rule, evidence): each record tied to the smallest record that has the same key.

    A star per key instead of all its pairs links the same records and grows with
    the rows, whatever the size of a key's group.
    """
    k = df.select(F.col(record).alias("r"), F.explode(keys).alias("key")).filter((F.col("key").isNotNull()) & (F.col("key") != "")).distinct()
    hub = k.groupBy("key").agg(F.min("r").alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "h")
    j = skew_left_join(k, hub, "key", hot_keys(k, "key"), "inner").filter("r <> h")
    return j.select(F.col("h").alias("src"), F.col("r").alias("dst"), F.lit(rule).alias("rule"), F.col("key").alias("evidence"))


def block_pairs(df: DataFrame, record: str, keys: Column) -> DataFrame:
    """(src, dst), src < dst: all pairs of records that share a key, once; large blocks are split."""
    k = df.select(F.explode(keys).alias("grp"), F.col(record).alias("entity")).filter("grp IS NOT NULL AND grp <> '' AND entity IS NOT NULL").distinct()
    return pairs_of(k)


def gated(candidates: DataFrame, evidence: list[DataFrame], blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(merges, queue): candidate pairs with evidence, first rule first, and those without.

    Evidence tables are (src, dst, rule, evidence) in order of trust; decided pairs
    in ``blocked`` (src, dst) are in neither result.
    """
    c = candidates.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    if blocked is not None:
        c = c.join(blocked.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), ["src", "dst"], "left_anti")
    tagged = [e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.struct(F.lit(k).alias("k"), "rule", "evidence").alias("e")) for k, e in enumerate(evidence)]
    best = reduce(DataFrame.unionByName, tagged).groupBy("src", "dst").agg(F.min("e").alias("e"))
    j = c.join(best, ["src", "dst"], "left")
    return j.filter("e IS NOT NULL").select("src", "dst", "e.rule", "e.evidence"), j.filter("e IS NULL").select("src", "dst")


def gated_classes(df: DataFrame, record: str, names: Column, evidence: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(merges, queue) of all pairs of records that share a name key, without building the pairs.

    ``evidence`` is (rule, key) in order of trust. Merges (src, dst, rule,
    evidence) tie the records of each (name key, evidence key) to the smallest of
    them; their components are those of all pairs that share both, and the rule is
    the first that the two records have in common. The queue (src, dst) ties the
    smallest record of each other component of a name key to the smallest of the
    key, so every component without evidence for the name stands in it.
    """
    work = Scratch(df.sparkSession, "gated")
    found = F.array_compact(F.array(*[F.when(key != "", F.struct(F.lit(k).alias("k"), F.lit(rule).alias("rule"), key.alias("evidence"))) for k, (rule, key) in enumerate(evidence)]))
    k = df.select(F.col(record).alias("r"), F.explode(F.array_distinct(names)).alias("name"), found.alias("ev")).filter("name IS NOT NULL AND name <> ''")
    k = work.save(k, "keys")
    sub = k.select("r", "ev", "name", F.explode("ev").alias("e")).select("r", "ev", F.to_json(F.struct("name", "e.k", "e.evidence")).alias("key"))
    hub = sub.groupBy("key").agg(F.min_by(F.struct(F.col("r").alias("h"), F.col("ev").alias("hev")), "r").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub.h", "hub.hev")
    j = skew_left_join(sub, hub, "key", hot_keys(sub, "key"), "inner").filter("r <> h")
    best = F.array_min(F.array_intersect("hev", "ev"))
    merges = j.select(F.col("h").alias("src"), F.col("r").alias("dst"), best.alias("e")).select("src", "dst", "e.rule", "e.evidence").distinct()
    merges = work.save(merges, "merges")
    labelled = k.select("r", "name").join(components(merges, "src", "dst").withColumnRenamed("id", "r"), "r", "left")
    reps = labelled.groupBy("name", F.coalesce("root", "r").alias("root")).agg(F.min("r").alias("rep"))
    least = reps.groupBy("name").agg(F.min("rep").alias("src"))
    queue = skew_left_join(reps.select("name", "rep"), least, "name", hot_keys(reps, "name"), "inner").filter("rep <> src")
    return merges, queue.select("src", F.col("rep").alias("dst")).distinct()


def survivors(records: DataFrame, record: str, weight: str, merges: DataFrame) -> DataFrame:
    """(dropped, kept): of each merged group the record of highest weight survives, ties to the smallest id."""
    comp = components(merges, "src", "dst")
    w = comp.join(records.select(F.col(record).alias("id"), F.col(weight).alias("w")), "id", "left")
    keep = w.groupBy("root").agg(F.min_by("id", F.struct(-F.coalesce("w", F.lit(0)), F.col("id"))).alias("kept"))
    return hub_join(w, keep, "root", "inner").filter("id <> kept").select(F.col("id").alias("dropped"), "kept")


def repointed(child: DataFrame, key: str, redirects: DataFrame) -> DataFrame:
    """A child table with retired ids replaced by their survivors."""
    r = redirects.select(F.col("dropped").alias(key), F.col("kept").alias("__to"))
    return hub_join(child, r, key).withColumn(key, F.coalesce("__to", key)).select(*child.columns)


def ambiguous(df: DataFrame, key: str, group: str, least: int = 2) -> DataFrame:
    """Keys that lead to ``least`` or more groups and so decide nothing."""
    return df.groupBy(key).agg(F.countDistinct(group).alias("groups")).filter(F.col("groups") >= least)


def match_weights(pairs: DataFrame, levels: dict[str, Column], prior: float = 0.01, rounds: int = 6) -> DataFrame:
    """``pairs`` with ``probability`` by Fellegi-Sunter: m and u of each comparison by expectation-maximisation.

    ``levels`` are small integer agreement levels. Pairs are first counted by
    pattern, so every round works on a table as small as the product of the
    levels; the pairs themselves are read twice, whatever the rounds.
    """
    work = Scratch(pairs.sparkSession, "linkage")
    names = list(levels)
    p = work.save(pairs.select("*", *[levels[n].cast("int").alias(f"__{n}") for n in names]), "pairs")
    pat = p.groupBy(*[f"__{n}" for n in names]).agg(F.count(F.lit(1)).cast("double").alias("c"))
    # a pattern table is bounded by the product of the levels
    rows = [r.asDict() for r in pat.collect()]
    lam = prior
    seen = {n: sorted({r[f"__{n}"] for r in rows if r[f"__{n}"] is not None}) for n in names}
    top = {n: max(v, default=0) for n, v in seen.items()}
    m = {n: {x: (0.8 if x == top[n] else 0.2 / max(1, len(v) - 1)) for x in v} for n, v in seen.items()}
    total = sum(r["c"] for r in rows) or 1.0
    u = {n: {x: sum(r["c"] for r in rows if r[f"__{n}"] == x) / total for x in v} for n, v in seen.items()}
    post = {}
    for _ in range(rounds):
        for i, r in enumerate(rows):
            a, b = lam, 1 - lam
            for n in names:
                x = r[f"__{n}"]
                if x is not None:
                    a *= m[n][x]
                    b *= u[n][x]
            post[i] = a / (a + b) if a + b else 0.0
        matched = sum(post[i] * r["c"] for i, r in enumerate(rows))
        lam = min(0.999, max(1e-9, matched / total))
        for n in names:
            for x in seen[n]:
                here = [(i, r) for i, r in enumerate(rows) if r[f"__{n}"] == x]
                m[n][x] = (sum(post[i] * r["c"] for i, r in here) + 1e-6) / (matched + 1e-6 * len(seen[n]))
                u[n][x] = (sum((1 - post[i]) * r["c"] for i, r in here) + 1e-6) / (total - matched + 1e-6 * len(seen[n]))
    keyed = F.concat_ws("|", *[F.coalesce(F.col(f"__{n}").cast("string"), F.lit("-")) for n in names])
    table = {"|".join("-" if r[f"__{n}"] is None else str(r[f"__{n}"]) for n in names): post.get(i, 0.0) for i, r in enumerate(rows)}
    if not table:
        return pairs.withColumn("probability", F.lit(0.0))
    score = pairs.sparkSession.createDataFrame(list(table.items()), "__k string, probability double")
    return p.withColumn("__k", keyed).join(F.broadcast(score), "__k").drop("__k", *[f"__{n}" for n in names])
