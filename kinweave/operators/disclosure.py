"""Statistical disclosure control over tables of counts.

D1 withholds counts below k. D3 withholds all but the dominating cell of a
group, and prints that cell as a bound. D5 withholds further cells until no
withheld one can be computed from totals. The tables are aggregates, bounded by
their key domains, and already small when they come here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch

K, DOMINANCE = 10, 0.9
#: Cells that stand for "missing" and so name nobody.
NO_NAME = ("-", "--", "?", "n/a", "none", "null", "tbd", "unknown", "미상", "미정", "없음")
#: Adjacent words of a text that may make up one name.
SPAN = 6


def primary(n: Column, k: int = K) -> Column:
    """D1 status of a count; an empty cell hides nobody."""
    return F.when((n > 0) & (n < k), "suppressed").otherwise("published")


def with_dominance(cells: DataFrame, group: list[str], n: str, status: str, k: int = K, least: float = DOMINANCE) -> DataFrame:
    """D3: where one published cell holds at least ``least`` of its group, it becomes a bound and the other filled cells are withheld."""
    w = Window.partitionBy(*group)
    total, top = F.sum(n).over(w), F.max(n).over(w)
    rules = (top >= least * total) & (top >= k)
    others = F.count_if(F.col(n) > 0).over(w) > 1
    new = F.when(rules & others & (F.col(n) == top), "bound").when(rules & others & (F.col(n) > 0), "suppressed").otherwise(F.col(status))
    return cells.withColumn(status, new)


def secondary(cells: DataFrame, margins: list[list[str]], key: list[str], n: str, status: str) -> DataFrame:
    """D5: in every row and column of ``margins`` with a published total, no cell is the only withheld one.

    Each round withholds one victim per equation that has exactly one withheld
    cell, the smallest published cell by (count, key), and rounds repeat until
    none is left. An equation whose cells are all withheld protects itself. The
    loop ends since every round withholds at least one more cell. A bound is an
    unknown, like a withheld cell.
    """
    scratch, k = Scratch(cells.sparkSession, "secondary"), 0
    work = scratch.save(cells, "c0")
    while True:
        victims = None
        for m in margins:
            w = Window.partitionBy(*m)
            hidden = F.count_if(F.col(status) != "published").over(w)
            order = F.row_number().over(Window.partitionBy(*m, F.col(status) == "published").orderBy(F.when(F.col(n) > 0, 0).otherwise(1), n, *key))
            v = work.withColumn("__h", hidden).withColumn("__r", order).filter((F.col("__h") == 1) & (F.col(status) == "published") & (F.col("__r") == 1)).select(*key)
            victims = v if victims is None else victims.unionByName(v)
        victims = victims.distinct().withColumn("__victim", F.lit(True))
        k += 1
        nxt = scratch.save(work.join(victims, key, "left").select(*[F.when(F.col("__victim"), F.lit("secondary")).otherwise(F.col(c)).alias(c) if c == status else F.col(c) for c in work.columns], F.coalesce("__victim", F.lit(False)).alias("__v")), f"c{k}")
        stop = nxt.filter("__v").limit(1).count() == 0
        work = nxt.drop("__v")
        scratch.keep_only(f"c{k}")
        if stop:
            return work


def shares(cells: DataFrame, group: list[str], n: str, status: str) -> DataFrame:
    """D2: with ``share``, a whole percentage of the group (halves go up), where every cell of the group is published; a bound stays one, the rest is suppressed."""
    w = Window.partitionBy(*group)
    total, whole = F.sum(n).over(w), F.bool_and(F.col(status) == "published").over(w)
    pct = F.floor(100 * F.col(n) / total + 0.5).cast("long").cast("string")
    return cells.withColumn("share", F.when(F.col(status) == "bound", ">=90").when(whole & (total > 0), pct).otherwise("suppressed"))


def full_shares(cells: DataFrame, group: list[str], n: str, least: float = DOMINANCE) -> DataFrame:
    """With ``share`` of the whole group, cells that will be left out included, so that an omission inflates none; from ``least`` on a bound. Null for an empty group."""
    total = F.sum(n).over(Window.partitionBy(*group))
    part = F.try_divide(F.col(n).cast("double"), total)
    return cells.withColumn("share", F.when(part >= least, ">=90").otherwise(F.floor(100 * part + 0.5).cast("long").cast("string")))


def unequal_margins(left: DataFrame, right: DataFrame, n: str, key: list[str]) -> DataFrame:
    """(*key, left_sum, right_sum): margins on which two tables of one population do not add up to the same; empty if they do."""
    a, b = (x.groupBy(*key).agg(F.sum(n).alias(f"{side}_sum")) for x, side in ((left, "left"), (right, "right")))
    return a.join(b, key, "full").filter(~F.col("left_sum").eqNullSafe(F.col("right_sum")))


#: Columns that name a person.
IDENTIFIERS = ("ledger_id", "gy_id", "name_ko", "name_en", "aliases", "source_url", "email", "cv_url")


def unsafe_cells(table: DataFrame, people: str, counts: list[str], k: int = K, ids: str = r"(?i)\b(?:LED|GY|ACT)-\d{4,}\b|https?://|\S+@\S+\.\S+") -> DataFrame:
    """(rule, column, value) of what a table of aggregates must not hold: a column that names a person, a value that may, a count of people under ``k``, a count that is no multiple of 5."""
    bad = [F.struct(F.lit("identifier column").alias("rule"), F.lit(c).alias("column"), F.lit(None).cast("string").alias("value")) for c in table.columns if c in IDENTIFIERS]
    tests = []
    for c in table.columns:
        v, number = F.col(c).cast("string"), F.col(c).cast("string").try_cast("long")
        as_ = lambda rule, c=c, v=v: F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), v.alias("value"))
        tests.append(F.when(v.rlike(ids), as_("identifier value")))
        if c == people:
            tests.append(F.when(number < k, as_("under k")))
        if c in counts:
            tests.append(F.when(number % 5 != 0, as_("not rounded")))
    spark = table.sparkSession
    rows = table.select(F.explode(F.array_compact(F.array(*tests))).alias("b")).select("b.*")
    return rows.unionByName(spark.range(1).select(F.explode(F.array(*bad)).alias("b")).select("b.*")) if bad else rows


def displayed(n: Column, status: Column) -> Column:
    """Printed form: rounded to 5, ``suppressed`` or ``>=90``."""
    return F.when(status == "published", (5 * F.floor((n + 2) / 5)).cast("string")).when(status == "bound", ">=90").otherwise("suppressed")


def differencing(published: DataFrame, known: DataFrame, keys: list[str], n: str, least: int) -> DataFrame:
    """Cells whose published count minus what is publicly known leaves fewer than ``least``, but someone."""
    j = published.join(known.select(*keys, F.col(n).alias("__k")), keys)
    left = F.col(n) - F.col("__k")
    return j.filter((left > 0) & (left < least)).select(*keys, left.alias("exposed"))


def leaks(texts: DataFrame, cell: str, secrets: DataFrame, token: str) -> DataFrame:
    """Rows of ``texts`` that hold a secret token, by equi-join on the words of the cell."""
    words = texts.withColumn("__w", F.explode(F.array_distinct(F.split(F.lower(cell), r"[^\p{L}\p{N}]+"))))
    hit = words.join(secrets.select(F.lower(token).alias("__w")).distinct(), "__w", "left_semi")
    return hit.drop("__w").distinct()


def name_tokens(name: Column) -> Column:
    """Normalised forms under which a name may be printed: letters and digits of the whole, and of its parts reversed.

    A Hangul name has two or more syllables, a Latin one four or more letters;
    shorter ones and stand-ins give nothing.
    """
    raw = F.regexp_replace(F.lower(name), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    parts = F.split(raw, r"[\s\p{Z}]+")
    whole, turned = (F.regexp_replace(x, r"[^\p{L}\p{N}]+", "") for x in (raw, F.array_join(F.reverse(parts), "")))
    hangul, latin = F.regexp_count(whole, F.lit("[가-힣]")) >= 2, F.regexp_count(whole, F.lit("[a-z]")) >= 4
    found = F.when(latin, F.array_distinct(F.array(whole, turned))).when(hangul, F.array(whole))
    return F.when(~raw.isin(*NO_NAME), found)


def name_leaks(texts: DataFrame, key: str, cell: str, tokens: DataFrame, token: str) -> DataFrame:
    """(key): texts in which a span of adjacent words, or a part of a URL, is one of the name tokens.

    A span is one word of two or more Hangul syllables or five or more Latin
    letters (four collide with ordinary words), or up to SPAN words written
    together, so a name is also found with other spaces. Spans longer than any
    token are dropped before the join.
    """
    known = tokens.select(F.col(token).alias("__w")).filter("__w IS NOT NULL AND __w <> ''").distinct()
    most = known.agg(F.max(F.length("__w"))).first()[0] or 0
    words = F.filter(F.split(F.lower(cell), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    links = F.regexp_extract_all(F.lower(cell), F.lit(r"https?://[^\s)>\"]+"), F.lit(0))
    pieces = F.flatten(F.transform(links, lambda u: F.transform(F.split(F.coalesce(F.try_url_decode(u), u), r"[^\p{L}\p{N}_-]+"), lambda p: F.regexp_replace(p, "[_-]+", ""))))
    df = texts.filter(F.col(cell).isNotNull()).select(key, words.alias("__s1"), pieces.alias("__u")).withColumn("__words", F.col("__s1"))
    for n in range(2, SPAN + 1):
        rest = F.slice("__words", F.lit(n), F.greatest(F.size("__words"), F.lit(1)))
        # a span past the end or longer than any token is null, and so is all that goes on from it
        longer = F.zip_with(F.col(f"__s{n - 1}"), rest, lambda a, b: F.when(F.length(a) + F.length(b) <= most, F.concat(a, b)))
        df = df.withColumn(f"__s{n}", longer)
    one = F.filter("__s1", lambda w: (F.regexp_count(w, F.lit("[a-z]")) >= 5) | (F.regexp_count(w, F.lit("[가-힣]")) >= 2))
    spans = F.array_distinct(F.concat(one, "__u", *[F.array_compact(f"__s{n}") for n in range(2, SPAN + 1)]))
    hit = df.select(key, F.explode(spans).alias("__w")).filter(F.length("__w").between(2, most)).join(known, "__w", "left_semi")
    return hit.select(key).distinct()
