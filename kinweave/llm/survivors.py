"""Best representative of each duplicate group.

``truths`` is the latent two-sided quality model: each source has a sensitivity
(how often it states a true value) and a specificity (how seldom it states a
false one), found by expectation-maximisation; every value whose probability of
being true passes the threshold is kept, so a field may keep several.

``survivors`` applies a fixed order of trust. A stated precedence cannot come
out of a probabilistic model, so the table of survivors is made by ordered
aggregation, field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: Words that stand for "missing".
STAND_INS = ("-", "--", "?", "n/a", "none", "null", "tbd", "unknown", "미상", "미정", "없음")
FIELDS = ("name_en", "affiliation", "country")
#: Estimation ends when no rate of any source moves by more than this.
TOLERANCE = 1e-4


def value_of(c: Column) -> Column:
    """The trimmed value, or null for a blank cell or a stand-in."""
    v = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when((v != "") & ~F.lower(v).isin(*STAND_INS), v)


def time_of(c: Column) -> Column:
    """Timestamp of a text: offsets honoured, none means UTC, a date alone is its midnight UTC; else null."""
    t = F.regexp_replace(F.trim(c), r"^(\d{4})[./](\d{1,2})[./](\d{1,2})\.?", "$1-$2-$3")
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    dated = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(t)
    stamped = F.when(dated.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}"), F.when(dated.rlike(r"(Z|[+-]\d{1,2}:\d{2})$"), dated).otherwise(F.concat(dated, F.lit("Z"))))
    return stamped.try_cast("timestamp")


def survivors(df: DataFrame, group: str, row_id: str, fields: tuple[str, ...], verified: Column, updated: Column) -> DataFrame:
    """(group, field, row_id): the row whose value survives, for groups of two or more rows.

    Of the rows with a value: verified first, then the latest time, then the
    smallest id; no time is oldest. Rows without a group are left out; a field
    nobody states gives no row. One shuffle by group; every aggregate is combined
    on the map side, so a hot group costs one row per task.
    """
    src = df.filter(value_of(F.col(group)).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).alias("i"), verified.alias("v"), F.unix_micros(updated).alias("t"), *[value_of(F.col(f)).isNotNull().alias(f"has_{k}") for k, f in enumerate(fields)])
    order = F.struct((~F.coalesce("v", F.lit(False))).alias("a"), F.coalesce(-F.col("t"), F.lit(2**62)).alias("b"), F.col("i"))
    best = src.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.min_by("i", F.when(F.col(f"has_{k}"), order)).alias(f"best_{k}") for k, _ in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"best_{k}").alias("i")) for k, f in enumerate(fields)])
    out = best.filter("n >= 2").select("g", F.explode(rows).alias("r")).filter("r.i IS NOT NULL")
    return out.select(F.col("g").alias(group), "r.field", F.col("r.i").alias(row_id))


def artist_survivors(artists: DataFrame) -> DataFrame:
    return survivors(artists, "gy_id", "ledger_id", FIELDS, F.col("verification") == "VERIFIED", time_of(F.col("updated_at")))


def truths(df: DataFrame, group: str, fields: tuple[str, ...], source: list[str], tolerance: float = TOLERANCE, keep: float = 0.5) -> DataFrame:
    """(group, field, value, probability, kept) of every stated value by the two-sided quality model.

    A source states or, by stating another value of the same field, denies a
    value. Null, blank and stand-in values are no statements. Starting from the
    share of statements a value has, quality and probabilities are re-estimated in
    turn, with a Beta prior on each rate, until no rate moves by more than
    ``tolerance``. A denial weighs the same for all values of a field of a group,
    so it is summed once for the field and never multiplied out over its values.
    """
    work = Scratch(df.sparkSession, "truths")
    src = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), value_of(F.col(f)).alias("value")) for f in fields])
    stated = df.filter(value_of(F.col(group)).isNotNull()).select(F.col(group).alias("g"), src.alias("s"), F.explode(cells).alias("c")).filter("c.value IS NOT NULL")
    said = work.save(stated.groupBy("g", F.col("c.field").alias("field"), F.col("c.value").alias("value"), "s").agg(F.count(F.lit(1)).cast("double").alias("n")), "said")
    covers = work.save(said.groupBy("g", "field", "s").agg(F.sum("n").alias("m")), "covers")
    cell, fact = ["g", "field"], ["g", "field", "value"]
    of_cell = covers.groupBy(*cell).agg(F.sum("m").alias("m"))
    belief = work.save(said.groupBy(*fact).agg(F.sum("n").alias("n")).join(of_cell, cell).select(*fact, (F.col("n") / F.col("m")).alias("p")), "belief0")
    rates, k = None, 0
    while True:
        k += 1
        mass = belief.groupBy(*cell).agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false"))
        yes = said.join(belief, fact).groupBy("s").agg(F.sum(F.col("p") * F.col("n")).alias("y1"), F.sum((1 - F.col("p")) * F.col("n")).alias("y0"))
        both = covers.join(mass, cell).groupBy("s").agg(F.sum(F.col("true") * F.col("m")).alias("b1"), F.sum(F.col("false") * F.col("m")).alias("b0"))
        now = work.save(yes.join(both, "s").select("s", ((F.col("y1") + 5) / (F.col("b1") + 10)).alias("sens"), ((F.col("y0") + 1) / (F.col("b0") + 10)).alias("false_pos")), f"rates{k}")
        denied = F.log((1 - F.col("sens")) / (1 - F.col("false_pos")))
        stated_by = F.log(F.col("sens") / F.col("false_pos"))
        base = covers.join(now, "s").groupBy(*cell).agg(F.sum(F.col("m") * denied).alias("base"))
        more = said.join(now, "s").groupBy(*fact).agg(F.sum(F.col("n") * (stated_by - denied)).alias("more"))
        belief = work.save(more.join(base, cell).select(*fact, (1 / (1 + F.exp(-(F.col("more") + F.col("base"))))).alias("p")), f"belief{k}")
        if rates is not None:
            was = rates.select("s", F.col("sens").alias("sens0"), F.col("false_pos").alias("false0"))
            moved = now.join(was, "s").agg(F.max(F.greatest(F.abs(F.col("sens") - F.col("sens0")), F.abs(F.col("false_pos") - F.col("false0"))))).first()[0]
            work.drop(f"rates{k - 1}")
        work.drop(f"belief{k - 1}")
        if rates is not None and (moved or 0.0) <= tolerance:
            break
        rates = now
    work.keep_only(f"belief{k}")
    return belief.select(F.col("g").alias(group), "field", "value", F.round("p", 6).alias("probability"), (F.col("p") >= keep).alias("kept"))
