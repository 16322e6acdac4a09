"""Connected components for rule-based merging: the smallest id is the root.

Alternating large-star and small-star rounds: every round is two map-side
combined aggregations and two joins over the edges, and the number of rounds is
logarithmic in the component size. Written tables cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .joins import balanced_join


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Connect the (larger or smaller) neighbours of each node to its smallest neighbour."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = balanced_join(both, least, "u", n * (1 + large), "inner")
    if large:
        kept = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        kept = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return kept.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, root) for every id on an edge to another one. Nulls and self-edges link nothing.

    Finished when a round changes no edge: its number of edges, and the sum of
    their hashes, counted while they are written, stay the same.
    """
    work = Scratch(edges.sparkSession, "components")
    x, y = F.col(src), F.col(dst)
    e, n = work.counted(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "e0")
    k, before = 0, None
    while n:
        k += 1
        star, n_star = work.counted(_star(e, n, large=True), f"l{k}")
        down = work.save(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"d{k}")
        e, n, mark = work.hashed(_star(down, n_star, large=False), f"e{k}")
        for old in (f"e{k - 1}", f"l{k}", f"d{k}"):
            work.drop(old)
        if (n, mark) == before:
            break
        before = (n, mark)
    work.keep_only(f"e{k}")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def follow(redirects: DataFrame, old: str, new: str) -> DataFrame:
    """(old, final): each retired id with the survivor at the end of its chain.

    Pointer doubling, so the rounds are the logarithm of the longest chain. An id
    redirected twice follows the smaller target. A chain that runs into a cycle
    ends at the smallest id of the cycle.
    """
    work = Scratch(redirects.sparkSession, "follow")
    first = redirects.filter(F.col(old) != F.col(new)).groupBy(F.col(old).alias("o")).agg(F.min(new).alias("n"))
    ptr, total = work.counted(first.select("o", "n", F.col("n").alias("low")), "p0")
    # after k rounds a pointer is 2**k steps ahead, and ``low`` the smallest id on those steps
    span, k = 1, 0
    while True:
        k += 1
        nxt = ptr.select(F.col("o").alias("n"), F.col("n").alias("n2"), F.col("low").alias("low2"))
        joined = balanced_join(ptr, nxt, "n", total)
        ptr = work.save(joined.select("o", F.coalesce("n2", "n").alias("n"), F.coalesce(F.least("low", "low2"), "low").alias("low"), F.col("n2").isNotNull().alias("open")), f"p{k}")
        span *= 2
        if span > total or not ptr.filter("open").take(1):
            break
        ptr = ptr.select("o", "n", "low")
    # pointers still open are inside a cycle: one more lap from there meets its members only
    cycle = ptr.filter("open").select("o", F.col("n").alias("at"))
    lap = ptr.select(F.col("o").alias("at"), F.col("low").alias("least"))
    ends = work.save(balanced_join(work.save(cycle, "cycle"), lap, "at", total).select("o", F.col("least").alias("end")), "ends")
    out = work.save(ptr.join(ends, "o", "left").select(F.col("o").alias(old), F.coalesce("end", "n").alias("final")), "final")
    work.keep_only("final")
    return out
