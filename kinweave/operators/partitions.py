"""How well a partition of entities agrees with ties between them, or with another partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .copresence import LISTED, pairs_or_members


def choose2(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def coverage(assignment: DataFrame, entity: str, group: str) -> DataFrame:
    """One row: entities, placed, share, groups, largest share and singletons of a partition (null group: unplaced)."""
    sizes = assignment.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    placed = F.col(group).isNotNull()
    agg = sizes.agg(F.sum("n").alias("entities"), F.coalesce(F.sum(F.when(placed, F.col("n"))), F.lit(0)).alias("placed"), F.count_if(placed).alias("groups"), F.max(F.when(placed, F.col("n"))).alias("largest"), F.count_if(placed & (F.col("n") == 1)).alias("singletons"))
    return agg.select("entities", "placed", F.round(F.try_divide(F.col("placed"), F.col("entities")), 9).alias("share"), "groups", F.round(F.try_divide(F.col("largest"), F.col("placed")), 9).alias("largest_share"), "singletons")


def adjusted_rand(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row with the adjusted Rand index of two partitions of the same entities; rows with a null label are left out."""
    cells = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    s = cells.agg(F.sum(choose2(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    a = cells.groupBy("l").agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("a"))
    b = cells.groupBy("r").agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("b"))
    one = s.crossJoin(a).crossJoin(b).withColumn("tt", choose2(F.col("t")))
    down = F.col("tt") * (F.col("a") + F.col("b")) - 2 * F.col("a") * F.col("b")
    same = (F.col("s") == F.col("a")) & (F.col("s") == F.col("b"))
    return one.select(F.when(same | (down == 0), 1.0).otherwise(F.round(F.try_divide(2 * (F.col("s") * F.col("tt") - F.col("a") * F.col("b")), down), 9)).alias("ari"))


def _scored(one: DataFrame) -> DataFrame:
    """Adds lift and auc to (same, total, t, s): pairs inside groups and in all, ties in all and inside; null where not defined."""
    defined = (F.col("t") > 0) & (F.col("t") != F.col("total")) & (F.col("same") > 0)
    inside = F.try_divide(F.col("s"), F.col("t"))
    lift = F.try_divide(inside, F.try_divide(F.col("same"), F.col("total")))
    auc = (inside + 1 - F.try_divide(F.col("same") - F.col("s"), F.col("total") - F.col("t"))) / 2
    return one.withColumns({"lift": F.when(defined, F.round(lift, 9)), "auc": F.when(defined, F.round(auc, 9))})


def _lift_of(placed: DataFrame, tied: DataFrame) -> DataFrame:
    """One row: ties, inside, lift, auc of the sums (t, s) over all pairs of ``placed``."""
    sizes = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.agg(F.sum(choose2(F.col("n"))).alias("same"), choose2(F.sum("n")).alias("total"))
    return _scored(base.crossJoin(tied)).select(F.col("t").cast("long").alias("ties"), F.col("s").cast("long").alias("inside"), "lift", "auc")


def _placed(assignment: DataFrame, entity: str, group: str) -> DataFrame:
    return assignment.filter(F.col(group).isNotNull()).select(F.col(entity).alias("e"), F.col(group).alias("g"))


def lift_auc(assignment: DataFrame, entity: str, group: str, ties: DataFrame) -> DataFrame:
    """One row: lift and AUC of ties falling inside groups, over all pairs of placed entities.

    Pairs are counted in closed form, never listed. Ties with an unplaced end are
    left out; the scores are null where every or no pair is tied or no pair is inside.
    """
    placed = _placed(assignment, entity, group)
    src, dst = placed.toDF("src", "gs"), placed.toDF("dst", "gd")
    tied = ties.join(src, "src").join(dst, "dst").agg(F.count(F.lit(1)).cast("double").alias("t"), F.count_if(F.col("gs") == F.col("gd")).cast("double").alias("s"))
    return _lift_of(placed, tied)


def copresent_lift(assignment: DataFrame, entity: str, group: str, members: DataFrame, listed: int = LISTED) -> DataFrame:
    """``lift_auc`` with the ties of ``members`` (grp, entity), which are not listed where they are too many to be joined."""
    ties, dense = pairs_or_members(members, listed)
    if dense is None:
        return lift_auc(assignment, entity, group, ties)
    placed = _placed(assignment, entity, group)
    counts = placed.groupBy(F.col("e").alias("entity"), F.col("g").alias("label")).agg(F.array(F.count(F.lit(1))).alias("counts"))
    tied = dense.tied(counts).agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    return _lift_of(placed, tied)


def counted_scores(people: DataFrame, entity: str, group: str, count: str, ties: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, pairs, ties, inside, lift, auc): as ``lift_auc`` where each entity is present ``count`` times.

    Two copies of one entity are no pair; a pair of different ones counts as often
    as their copies meet. ``by`` names draws that are scored side by side. Scores
    are null where they are not defined.
    """
    by = by or []
    p = people.filter(F.col(group).isNotNull() & (F.col(count) > 0)).select(*by, F.col(entity).alias("e"), F.col(group).alias("g"), F.col(count).cast("double").alias("c"))
    base = _base(p, by)
    src, dst = p.toDF(*by, "src", "gs", "cs"), p.toDF(*by, "dst", "gd", "cd")
    both = ties.select("src", "dst").join(src, "src").join(dst, ["dst", *by])
    w = F.col("cs") * F.col("cd")
    tied = both.groupBy(*by).agg(F.sum(w).alias("t"), F.sum(F.when(F.col("gs") == F.col("gd"), w).otherwise(0.0)).alias("s"))
    return _counted(base, tied, by)


def _base(p: DataFrame, by: list[str]) -> DataFrame:
    """(*by, total, same) of (*by, e, g, c): pairs of copies of different entities, and those inside groups."""
    sizes = p.groupBy(*by, "g").agg(F.sum("c").alias("n"), F.sum(choose2(F.col("c"))).alias("own"))
    return sizes.groupBy(*by).agg((choose2(F.sum("n")) - F.sum("own")).alias("total"), (F.sum(choose2(F.col("n"))) - F.sum("own")).alias("same"))


def _counted(base: DataFrame, tied: DataFrame, by: list[str]) -> DataFrame:
    """(*by, pairs, ties, inside, lift, auc) of ``_base`` and the sums (*by, t, s) over ties."""
    one = (base.join(tied, by, "left") if by else base.crossJoin(tied)).withColumn("t", F.coalesce("t", F.lit(0.0))).withColumn("s", F.coalesce("s", F.lit(0.0)))
    return _scored(one).select(*by, F.col("total").cast("long").alias("pairs"), F.col("t").cast("long").alias("ties"), F.col("s").cast("long").alias("inside"), "lift", "auc")


#: Cumulative probabilities of a Poisson(1) count of 0, 1, 2 and so on.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson_count(seed: int, draw: Column, entity: Column) -> Column:
    """A Poisson(1) count from a hash of (seed, draw, entity): the same wherever and however often it is made."""
    return _poisson(_uniform(seed, draw, entity))


def _uniform(seed: int, draw: Column, entity: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), draw, entity), F.lit(1 << 40)) / float(1 << 40)


def _poisson(u: Column) -> Column:
    return reduce(lambda rest, k: F.when(u < POISSON[k], F.lit(k)).otherwise(rest), reversed(range(len(POISSON))), F.lit(len(POISSON)))


def _drawn(df: DataFrame, entity: str, draws: int, seed: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("times", poisson_count(seed, F.col("draw"), F.col(entity)))


def score_intervals(assignment: DataFrame, entity: str, group: str, ties: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
    """One row: 95 % percentile intervals (linear) of lift and AUC over draws of entities, and in how many draws they are defined.

    Draws are made of the tied pairs, not of the entities before they meet their ties. Entities are merged to them,
    since all of them may be too many for the driver to broadcast.
    """
    placed = _placed(assignment, entity, group)
    src, dst = (placed.select(F.col("e").alias(end), F.col("g").alias(f"g_{end}"), F.col("e").alias(f"e_{end}")) for end in ("src", "dst"))
    both = ties.select("src", "dst").join(src.hint("merge"), "src").join(dst.hint("merge"), "dst").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = (poisson_count(seed, F.col("draw"), F.col("e_src")) * poisson_count(seed, F.col("draw"), F.col("e_dst"))).cast("double")
    weighed = both.select("draw", w.alias("w"), (F.col("g_src") == F.col("g_dst")).alias("inside"))
    tied = weighed.groupBy("draw").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0.0)).alias("s"))
    return _intervals(placed, tied, draws, seed)


def copresent_intervals(assignment: DataFrame, entity: str, group: str, members: DataFrame, draws: int = 200, seed: int = 1, listed: int = LISTED) -> DataFrame:
    """``score_intervals`` with the ties of ``members`` (grp, entity), which are not listed where they are too many to be joined."""
    ties, dense = pairs_or_members(members, listed)
    if dense is None:
        return score_intervals(assignment, entity, group, ties, draws, seed)
    placed = _placed(assignment, entity, group)
    # one hash per draw, read by all the comparisons of its count
    u = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda k: _uniform(seed, k, F.col("entity")))
    counts = F.transform(u, lambda x: _poisson(x).cast("tinyint"))
    return _intervals(placed, dense.tied(placed.toDF("entity", "label"), counts), draws, seed)


def _intervals(placed: DataFrame, tied: DataFrame, draws: int, seed: int) -> DataFrame:
    """The intervals of the sums (draw, t, s) over ties of drawn entities."""
    drawn = _drawn(placed, "e", draws, seed).filter("times > 0").select("draw", "e", "g", F.col("times").cast("double").alias("c"))
    got = _counted(_base(drawn, ["draw"]), tied, ["draw"])
    ends = lambda c, q: F.round(F.percentile(c, F.lit(q)), 9)
    return got.agg(F.count("lift").alias("defined"), ends("lift", 0.025).alias("lift_lo"), ends("lift", 0.975).alias("lift_hi"), ends("auc", 0.025).alias("auc_lo"), ends("auc", 0.975).alias("auc_hi"))


def stability(pairs: DataFrame, entity: str, left: str, right: str, draws: int = 200, seed: int = 1) -> DataFrame:
    """One row: mean and 5 % to 95 % percentiles of the adjusted Rand index of two partitions over draws of entities, and the mean share a draw leaves out.

    Each entity of a draw counts once, however often it is drawn.
    """
    p = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(entity).alias("e"), F.col(left).alias("l"), F.col(right).alias("r"))
    d = _drawn(p, "e", draws, seed)
    kept = d.filter("times > 0")
    cells = kept.groupBy("draw", "l", "r").agg(F.count(F.lit(1)).alias("n"))
    s = cells.groupBy("draw").agg(F.sum(choose2(F.col("n"))).alias("s"), choose2(F.sum("n")).alias("tt"))
    a = cells.groupBy("draw", "l").agg(F.sum("n").alias("n")).groupBy("draw").agg(F.sum(choose2(F.col("n"))).alias("a"))
    b = cells.groupBy("draw", "r").agg(F.sum("n").alias("n")).groupBy("draw").agg(F.sum(choose2(F.col("n"))).alias("b"))
    down = F.col("tt") * (F.col("a") + F.col("b")) - 2 * F.col("a") * F.col("b")
    same = (F.col("s") == F.col("a")) & (F.col("s") == F.col("b"))
    ari = F.when(same | (down == 0), 1.0).otherwise(F.try_divide(2 * (F.col("s") * F.col("tt") - F.col("a") * F.col("b")), down))
    got = s.join(a, "draw").join(b, "draw").select("draw", ari.alias("ari"))
    left_out = d.groupBy("draw").agg((F.count_if(F.col("times") == 0) / F.count(F.lit(1))).alias("o"))
    one = got.agg(F.count("ari").alias("draws"), F.round(F.avg("ari"), 9).alias("ari"), F.round(F.percentile("ari", F.lit(0.05)), 9).alias("ari_lo"), F.round(F.percentile("ari", F.lit(0.95)), 9).alias("ari_hi"))
    return one.crossJoin(left_out.agg(F.round(F.avg("o"), 9).alias("left_out")))


def bootstrap_mean(df: DataFrame, entity: str, value: str, group: list[str], draws: int = 200, seed: int = 1) -> DataFrame:
    """(*group, n, mean, lo, hi): percentile bootstrap of a mean over entities.

    Each entity gets an independent Poisson(1) weight per draw, derived from a hash
    of (seed, draw, entity), so draws need no resampling pass and the result does
    not depend on the partitioning. Intervals are widened to hold the mean.
    """
    ready = df.filter(F.col(value).isNotNull()).select(*group, F.col(entity).alias("e"), F.col(value).cast("double").alias("v"))
    weight = poisson_count(seed, F.col("d"), F.col("e"))
    drawn = ready.select(*group, "e", "v", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("d")).withColumn("w", weight)
    means = drawn.groupBy(*group, "d").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    ends = means.groupBy(*group).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    point = ready.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    joined = point.join(ends, group) if group else point.crossJoin(ends)
    return joined.select(*group, "n", "mean", F.least("lo", "mean").alias("lo"), F.greatest("hi", "mean").alias("hi"))
