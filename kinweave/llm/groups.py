"""Consolidating pairwise matches into groups.

The pair graph is shrunk until no edge is left, then labels flow back:

* strip   - every vertex of degree one hangs itself onto its neighbour;
* compress - chains of degree-two vertices are shortened as in list ranking by
  independent sets: a chain vertex whose random rank is the smallest among its
  degree-two neighbours leaves, and its two neighbours are joined by an edge;
* core    - what has few vertices of degree one or two, or is a hundredth of all
  edges, is solved: while it is large, vertices join the neighbour that is a local
  minimum of the random ranks and edges are relabelled; once it has ``CORE_EDGES``
  edges or fewer, in one task.

A removed vertex keeps one parent that outlives it, so the parents form a forest
no deeper than the number of rounds; pointer doubling over it restores labels in
its logarithm. A strip round is three map-side combined aggregations without a
join, so hubs are never gathered; nothing is collected but counts and hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import balanced_join
from ..storage import Scratch

#: A round that removes fewer vertices than this share of the edges calls for the core step.
CORE_SHARE = 0.05
#: So does a rest of this share of all edges that fits one task: the tails of the longest chains, not worth rounds of their own.
REST_SHARE = 0.01
#: Edges of a core one task solves: about 100 MB of ids.
CORE_EDGES = 500_000


def match_groups(pairs: DataFrame, a: str, b: str, member: str = "member", group: str = "group_id", core_edges: int = CORE_EDGES) -> DataFrame:
    """(member, group) for every id linked to another one; group is the smallest id of its component.

    A pair with a null id, or with one id twice, links nothing; repeated and
    turned pairs count once; an empty table gives an empty result. Other columns
    of ``pairs`` are ignored, whatever their names.
    """
    spark = pairs.sparkSession
    work = Scratch(spark, "groups")
    x, y = F.col("a"), F.col("b")
    edges = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter(x != y)
    edges = edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")
    edges, n = work.counted(edges, "edges0")
    parents: list[DataFrame] = []
    first, total, k = n, 0, 0
    while n:
        k += 1
        core = n <= min(core_edges, REST_SHARE * first)
        if not core:
            gone, n_gone = work.counted(_low_degree_step(edges), f"gone{k}")
            core = n_gone < CORE_SHARE * n
        if core:
            solve = _solved(edges) if n <= core_edges else _core_step(edges, n)
            gone, n_gone = work.counted(solve, f"core{k}")
        parents.append(gone.select("v", "parent"))
        total += n_gone
        if core and n <= core_edges:
            break
        edges, n = work.counted(_contracted(edges, gone, n) if core else _without(edges, gone), f"edges{k}")
        work.drop(f"edges{k - 1}")
    if not parents:
        return edges.select(F.col("a").alias(member), F.col("a").alias(group))
    forest = parents[0]
    for p in parents[1:]:
        forest = forest.unionByName(p)
    return _labels(forest, len(parents), total, work, member, group)


def _rank(c: F.Column) -> F.Column:
    """A random order, the same in every round, so that every round runs the same compiled code; the id breaks ties."""
    return F.struct(F.xxhash64(c), c)


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")


def _low_degree_step(edges: DataFrame) -> DataFrame:
    """Vertices of degree one, and an independent set of those of degree two: (v, parent, other).

    Every vertex of low degree tells its neighbours so; what a vertex hears is
    combined on the map side, so a hub hears all its leaves at the cost of one row
    a task.
    """
    low = _arcs(edges).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("w").alias("lo"), F.max("w").alias("hi")).filter("deg <= 2")
    none = F.lit(None)
    own = F.struct(F.col("v").alias("to"), F.col("deg"), F.col("lo"), F.col("hi"), none.cast("bigint").alias("far"), none.cast("string").alias("u"))
    told = lambda w: F.struct(w.alias("to"), none.cast("bigint").alias("deg"), none.cast("string").alias("lo"), none.cast("string").alias("hi"), F.col("deg").alias("far"), F.col("v").alias("u"))
    said = low.select(F.explode(F.when(F.col("deg") == 1, F.array(own, told(F.col("lo")))).otherwise(F.array(own, told(F.col("lo")), told(F.col("hi"))))).alias("m")).select("m.*")
    seen = said.groupBy(F.col("to").alias("v")).agg(
        F.max("deg").alias("deg"),
        F.max("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.max((F.col("far") == 1).cast("int")).alias("by_leaf"),
        F.min(F.when(F.col("far") == 2, _rank(F.col("u")))).alias("first"),
    )
    alone = F.coalesce(F.col("by_leaf"), F.lit(0)) == 0
    leaf = (F.col("deg") == 1) & (alone | (F.col("v") > F.col("lo")))
    chain = (F.col("deg") == 2) & alone & (F.col("first").isNull() | (_rank(F.col("v")) < F.col("first")))
    return seen.filter(leaf | chain).select("v", F.col("lo").alias("parent"), F.when(F.col("deg") == 2, F.col("hi")).alias("other"))


def _core_step(edges: DataFrame, n: int) -> DataFrame:
    """Vertices next to a local minimum of the ranks: (v, parent)."""
    arcs = _arcs(edges)
    least = arcs.groupBy("v").agg(F.min(_rank(F.col("w"))).alias("m"))
    roots = least.filter(_rank(F.col("v")) < F.col("m")).select(F.col("v").alias("w"))
    marked = balanced_join(arcs, roots, "w", 2 * n, "inner")
    return marked.groupBy("v").agg(F.min_by("w", _rank(F.col("w"))).alias("parent")).select("v", "parent")


def _contracted(edges: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """The edges left once the vertices in ``gone`` are merged into their parents."""
    for end in ("a", "b"):
        to = gone.select(F.col("v").alias(end), F.col("parent").alias("to"))
        edges = balanced_join(edges, to, end, n).withColumn(end, F.coalesce("to", end)).drop("to")
    x, y = F.col("a"), F.col("b")
    return edges.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _solved(edges: DataFrame) -> DataFrame:
    """(v, parent) of a core of bounded size, by union-find in one task; the parent is the smallest id of its component."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[str, str] = {}

        def top(x: str) -> str:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = sorted((top(a), top(b)))
                up[b] = a
        out = [(v, top(v)) for v in up if top(v) != v]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], names=["v", "parent"])

    return edges.repartition(1).mapInArrow(solve, "v string, parent string")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges left once ``gone`` is removed and the ends of its chain vertices are joined."""
    pair = lambda p, q, t: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.lit(t).alias("t"))
    v, lo, hi = F.col("v"), F.col("parent"), F.col("other")
    changes = gone.select(F.explode(F.filter(F.array(pair(v, lo, -1), F.when(hi.isNotNull(), pair(v, hi, -1)), F.when(hi.isNotNull(), pair(lo, hi, 1))), lambda s: s.isNotNull())).alias("e")).select("e.*")
    tagged = edges.withColumn("t", F.lit(0)).unionByName(changes)
    kept = tagged.groupBy("a", "b").agg(F.min("t").alias("lost"), F.max("t").alias("new"))
    return kept.filter((F.col("lost") == 0) | (F.col("new") == 1)).select("a", "b")


def _labels(forest: DataFrame, rounds: int, total: int, work: Scratch, member: str, group: str) -> DataFrame:
    """Pointer doubling to the roots, then the smallest id under each root."""
    ptr = forest
    for k in range(1, max(1, (rounds - 1).bit_length()) + 1):
        up = ptr.select(F.col("v").alias("parent"), F.col("parent").alias("next"))
        ptr = balanced_join(ptr, up, "parent", total).select("v", F.coalesce("next", "parent").alias("parent"))
        ptr = work.save(ptr, f"ptr{k}")
        work.keep_only(f"ptr{k}")
    least = ptr.groupBy("parent").agg(F.least(F.min("v"), F.col("parent")).alias("g"))
    least = work.save(least, "least")
    named = balanced_join(ptr, least, "parent", total).select(F.col("v").alias(member), F.col("g").alias(group))
    return named.unionByName(least.select(F.col("parent").alias(member), F.col("g").alias(group)))
