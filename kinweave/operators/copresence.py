"""Entities present together: a bipartite table of entities and groups, and its pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .dense_pairs import Members, blocks_for
from .joins import hot_keys, skew_left_join

#: Members a block of a large group may hold; pairs of blocks are the unit of work.
BLOCK = 1000
#: Pairs, counted in every group that has them, up to which they are joined and made distinct.
LISTED = 5_000_000
#: About what is shuffled for a joined pair, and for a member each time it is packed.
JOINED_BYTES, PACKED_BYTES = 8, 2


def presences(df: DataFrame, entity: str, group: list[Column], keep: Column) -> DataFrame:
    """(grp, entity): distinct entities per group over the kept rows; null keys are left out."""
    grp = F.struct(*[g.alias(f"k{i}") for i, g in enumerate(group)])
    some = F.col(entity).isNotNull()
    for g in group:
        some = some & g.isNotNull()
    return df.filter(keep & some).select(grp.alias("grp"), F.col(entity).alias("entity")).distinct()


def pairs_of(members: DataFrame, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """(src, dst), src < dst: distinct unordered pairs that share at least one group.

    The pairs are the result by definition; up to ``listed`` of them, counted in
    every group that has them, are joined and made distinct. More of them, and far
    more than members, are found as bits, where a pair exists once (``dense_pairs``).
    The members are written once, so the source is scanned once.
    """
    ties, dense = pairs_or_members(members, listed, block)
    return dense.pairs() if dense else ties


def pairs_or_members(members: DataFrame, listed: int = LISTED, block: int = BLOCK) -> tuple[DataFrame | None, Members | None]:
    """Pairs where they are few enough to be joined, else the members they can be summed up from."""
    members, total, most, dense = _weighed(members, listed)
    return (None, dense) if dense else (_joined(members, total, most, block), None)


def _weighed(members: DataFrame, listed: int) -> tuple[DataFrame, int, int, Members | None]:
    """Written members, their number, the largest group, and their numbered form where the pairs are too many to be joined."""
    members, total = Scratch(members.sparkSession, "pairs").counted(members.select("grp", "entity"), "members")
    n = F.col("n").cast("double")
    one = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).alias("pairs")).first()
    dense = one["pairs"] > listed
    if dense:
        entities = members.agg(F.approx_count_distinct("entity")).first()[0]
        dense = one["pairs"] * JOINED_BYTES > total * blocks_for(entities) * PACKED_BYTES
    return members, total, one["most"], Members(members, total) if dense else None


def _joined(members: DataFrame, total: int, most: int, block: int) -> DataFrame:
    """Distinct pairs by a join on the group, which no task holds.

    A group of n members is cut into ceil(n / block) blocks by hash, and every pair
    of blocks is joined on its own key. Groups of one give no pair.
    """
    if most <= block:
        return _within(members).distinct()
    large = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    m = skew_left_join(members, large, "grp", hot_keys(members, "grp", total=total)).withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    m = m.select("grp", "entity", "blocks", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int").alias("b"))
    pairs = _within(m.filter("blocks = 1").select("grp", "entity"))
    # each member of a large group goes to every pair of blocks that holds its own
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    large = m.filter("blocks > 1").select("grp", "entity", "b", F.explode(other).alias("o"))
    cells = large.select("grp", "entity", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    u, v = cells.alias("u"), cells.alias("v")
    same = (F.col("u.grp") == F.col("v.grp")) & (F.col("u.lo") == F.col("v.lo")) & (F.col("u.hi") == F.col("v.hi"))
    wanted = (F.col("u.entity") < F.col("v.entity")) & ((F.col("u.lo") == F.col("u.hi")) | (F.col("u.b") != F.col("v.b")))
    hot = u.join(v, same).filter(wanted).select(F.col("u.entity").alias("src"), F.col("v.entity").alias("dst"))
    return pairs.unionByName(hot).distinct()


def _within(members: DataFrame) -> DataFrame:
    """(src, dst) of all pairs inside each group of at most one block."""
    x, y = members.alias("x"), members.alias("y")
    return x.join(y, F.col("x.grp") == F.col("y.grp")).filter(F.col("x.entity") < F.col("y.entity")).select(F.col("x.entity").alias("src"), F.col("y.entity").alias("dst"))


def degrees(ties: DataFrame) -> DataFrame:
    """(entity, degree): number of partners of each entity with one."""
    ends = ties.select(F.explode(F.array("src", "dst")).alias("entity"))
    return ends.groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


def degrees_of(members: DataFrame, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """``degrees`` of the pairs of ``members``, which are not listed where they are too many to be joined."""
    ties, dense = pairs_or_members(members, listed, block)
    return dense.degrees() if dense else degrees(ties)


def limited(ties: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """Ties with both ends among ``people``."""
    some = people.select(F.col(key).alias("p")).distinct()
    return ties.join(some, ties["src"] == some["p"], "left_semi").join(some, ties["dst"] == some["p"], "left_semi")


def among(members: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """Members among ``people``: their pairs are those of ``members`` that ``limited`` keeps."""
    some = people.select(F.col(key).alias("p")).distinct()
    return members.join(some, members["entity"] == some["p"], "left_semi")


def layers(base: DataFrame, entity: str, keep: Column, group: dict[str, list[Column]]) -> DataFrame:
    """(layer, ties, added): pair counts under ever coarser group keys, and how many each layer adds.

    The layers are cumulative: a pair counts where it first appears.
    """
    seen = None
    for k, (name, cols) in enumerate(group.items()):
        ties = pairs_of(presences(base, entity, cols, keep)).select("src", "dst", F.lit(k).alias("k"), F.lit(name).alias("layer"))
        seen = ties if seen is None else seen.unionByName(ties)
    seen = Scratch(base.sparkSession, "layers").save(seen, "seen")
    first = seen.groupBy("src", "dst").agg(F.min("k").alias("k0"))
    added = first.groupBy(F.col("k0").alias("k")).agg(F.count(F.lit(1)).alias("added"))
    total = seen.groupBy("k", "layer").agg(F.count(F.lit(1)).alias("ties"))
    return total.join(added, "k", "left").select("layer", "ties", F.coalesce("added", F.lit(0)).cast("long").alias("added"))
