"""Venue spellings merged to entities: word bags, parts of a site, and readings across scripts.

Every rule gives edges between keys; components of the edges are the entities, so
nothing depends on the order of rows. The rules stand in a sequence only where one
asks which keys are already one entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.venue_names import ACRONYM, PLACE_MARK, Venues
from ..shipping import ship
from ..storage import Scratch
from .components import components

#: Entries of the place table every task may hold; more are refused.
MOST_PLACES = 2_000_000
_READ = "spelling string, city string, key string, acronym string, bag string, across string, readings array<string>, signature string, parent string, branch_of string, branch_city string, office string, place string, rest string, rest_city string"


def read_names(spellings: DataFrame, spelling: str, city: str, places: DataFrame, place_key: str, place_city: str) -> DataFrame:
    """What each distinct (spelling, city) says, one row each: its key and what the rules need.

    ``places`` is a reference list held in every task; its size is checked. A
    generic name carries the city of its row in its key. Null and blank spellings
    give no row.
    """
    spark = spellings.sparkSession
    ship(spark)
    table = places.filter(F.col(place_key).isNotNull()).select(place_key, F.regexp_replace(F.lower(F.coalesce(place_city, F.lit(""))), "-(?:si|gun|gu|do|eup)$", "")).distinct()
    n = table.count()
    if n > MOST_PLACES:
        raise ValueError(f"the place table holds {n} entries; at most {MOST_PLACES} are held in a task")
    held = spark.sparkContext.broadcast({r[0]: r[1] for r in table.collect()})
    src = spellings.select(F.col(spelling).alias("spelling"), F.coalesce(F.col(city), F.lit("")).alias("city")).filter(F.trim("spelling") != "").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Venues(held.value)
        join = lambda bag: " ".join(bag) if bag else None
        for b in batches:
            out = []
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key = v.key(s)
                first, _, rest = key.partition(" ")
                own = (s, c, key, first if ACRONYM.fullmatch(s.split(" ", 1)[0]) else None)
                if c and v.generic(key):
                    out.append((*own[:2], f"{key}{PLACE_MARK}{c.casefold()}", own[3], None, None, [], None, "", "", "", "", "", "", ""))
                    continue
                office = v.office_of(key)
                hangul = [join(x) for x in v.bags(key)]
                out.append((*own, join(v.latin_bag(key)), join(v.latin_bag(key, True)), hangul, join(v.signature(key)), v.parent(key), *v.branch(key), v.city(office), v.city(key) if key in v.places else "", rest, v.city(rest) if rest in v.places else ""))
            cols = list(zip(*out)) or [()] * 15
            kinds = [pa.string()] * 6 + [pa.list_(pa.string())] + [pa.string()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _READ.split(", ")])

    return src.mapInArrow(run, _READ).filter("key <> ''")


def _stars(rows: DataFrame, by: str) -> DataFrame:
    """(src, dst): every key tied to the smallest of its group."""
    least = rows.groupBy(by).agg(F.min("key").alias("src"))
    return rows.join(least, by).filter("src <> key").select("src", F.col("key").alias("dst"))


def merge_edges(read: DataFrame, rows: DataFrame, spelling: str, city: str, work: Scratch, rules: tuple[str, ...] = ("V7", "V8", "V9")) -> DataFrame:
    """(rule, src, dst) between keys. ``read`` is ``read_names``, ``rows`` the uses of the spellings with the city written beside each."""
    keys = work.save(read.groupBy("key").agg(*[F.max(c).alias(c) for c in ("bag", "across", "signature", "parent", "branch_of", "branch_city", "office", "place", "rest", "rest_city")], F.max("readings").alias("readings"), F.max("acronym").alias("acronym")), "keys")
    names = keys.filter(~F.col("key").contains(PLACE_MARK))
    edges = []
    if "V7" in rules:
        edges.append(_stars(names.filter("bag IS NOT NULL").select("key", "bag"), "bag").select(F.lit("V7e").alias("rule"), "src", "dst"))
    if "V8" in rules:
        known = names.select(F.col("key").alias("parent"))
        parts = names.filter("parent <> ''").select("key", "parent").join(known, "parent", "left_semi")
        edges.append(parts.select(F.lit("V8").alias("rule"), F.col("parent").alias("src"), F.col("key").alias("dst")))
    so_far = work.save(_allowed(_union(edges, keys), names), "first") if edges else _union(edges, keys)
    if "V8" in rules:
        so_far = work.save(so_far.unionByName(_allowed(_acronyms(names, read, rows, spelling, city, so_far, work), names)), "second")
    if "V9" in rules:
        so_far = work.save(so_far.unionByName(_allowed(_across(names, so_far, work), names)), "third")
    return so_far


def _union(edges: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0).select(F.lit("").alias("rule"), F.col("key").alias("src"), F.col("key").alias("dst"))
    for e in edges:
        out = out.unionByName(e)
    return out


def _allowed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges that do not join a place with the office that administers it."""
    at = lambda end: names.select(F.col("key").alias(end), F.col("office").alias(f"{end}_office"), F.when(F.col("place") != "", F.col("place")).otherwise(F.col("key")).alias(f"{end}_place"))
    j = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    clash = lambda a, b: (F.col(f"{a}_office") != "") & (F.col(f"{a}_office") == F.col(f"{b}_place"))
    return j.filter(~F.coalesce(clash("src", "dst") | clash("dst", "src"), F.lit(False))).select("rule", "src", "dst").distinct()


def _roots(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, root) of every name under the edges so far."""
    found = components(edges, "src", "dst").withColumnRenamed("id", "key")
    return names.select("key").join(found, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def _acronyms(names: DataFrame, read: DataFrame, rows: DataFrame, spelling: str, city: str, edges: DataFrame, work: Scratch) -> DataFrame:
    """An acronym followed by a city is the acronym, where that city alone is its site."""
    roots = work.save(_roots(names, edges), "roots8")
    known = read.filter("acronym IS NOT NULL").select(F.col("acronym").alias("first")).distinct()
    sites = names.filter("rest_city <> ''").select("key", F.split("key", " ")[0].alias("first"), F.col("rest_city").alias("site")).join(known, "first", "left_semi")
    sites = sites.join(names.filter("bag IS NOT NULL OR size(readings) > 0").select(F.col("key").alias("first")), "first", "left_semi")
    branches = names.filter("branch_of <> ''").select(F.col("branch_of").alias("key"), F.col("branch_city").alias("site")).join(roots, "key").select("root", "site").distinct()
    own_branches = roots.withColumnRenamed("key", "first").join(branches, "root").select("first", "site")
    every = sites.select("first", "site").unionByName(own_branches).groupBy("first").agg(F.countDistinct("site").alias("sites"), F.min("site").alias("only"))
    # the city most rows write beside the bare acronym, if one is ahead of all others
    beside = rows.select(F.col(spelling).alias("spelling"), F.lower(F.col(city)).alias("c")).filter("c IS NOT NULL AND c <> ''").join(read.select("spelling", F.col("key").alias("first")).distinct(), "spelling").groupBy("first", "c").agg(F.count(F.lit(1)).alias("n"))
    top = beside.groupBy("first").agg(F.max(F.struct("n", "c")).alias("hi"), F.min(F.struct((-F.col("n")).alias("m"), "c")).alias("lo")).filter("hi.c = lo.c").select("first", F.col("hi.c").alias("home"))
    got = sites.join(every.filter("sites = 1"), "first").join(top, "first").filter((F.col("site") == F.col("only")) & (F.col("home") == F.lower("site")))
    return got.select(F.lit("V8").alias("rule"), F.col("first").alias("src"), F.col("key").alias("dst"))


def _across(names: DataFrame, edges: DataFrame, work: Scratch) -> DataFrame:
    """Hangul and Latin names of one reading, where it is the only one of its component."""
    roots = work.save(_roots(names, edges), "roots9")
    latin = work.save(names.filter("across IS NOT NULL").select("key", F.col("across").alias("bag")).join(roots, "key").select("bag", F.col("root").alias("latin")).distinct(), "latin")
    read = work.save(names.filter("size(readings) > 0").select("key", "signature", F.posexplode("readings").alias("pos", "bag")).join(roots, "key"), "readings")
    alike = read.groupBy("bag").agg(F.countDistinct("signature").alias("s"), F.countDistinct("root").alias("r")).filter("s >= 2 AND r >= 2").select("bag")
    # the first reading that any Latin name has decides
    first = read.join(latin.select("bag").distinct(), "bag", "left_semi").groupBy("key", "root").agg(F.min(F.struct("pos", "bag")).alias("b")).select(F.col("root").alias("hangul"), F.col("b.bag").alias("bag")).distinct()
    pairs = work.save(first.join(alike, "bag", "left_anti").join(latin, "bag").select("hangul", "latin", "bag").distinct(), "pairs")
    comp = components(pairs.select(F.concat(F.lit("h:"), "hangul").alias("a"), F.concat(F.lit("l:"), "latin").alias("b")), "a", "b")
    tagged = pairs.join(comp.select(F.regexp_replace("id", "^h:", "").alias("hangul"), "root").filter(F.col("id").startswith("h:")), "hangul")
    clear = tagged.groupBy("root").agg(F.countDistinct("bag").alias("n")).filter("n = 1")
    return tagged.join(clear, "root", "left_semi").filter("hangul <> latin").select(F.lit("V9").alias("rule"), F.col("hangul").alias("src"), F.col("latin").alias("dst"))


def venue_entities(rows: DataFrame, spelling: str, city: str, places: DataFrame, place_key: str, place_city: str, rules: tuple[str, ...] = ("V7", "V8", "V9")) -> tuple[DataFrame, DataFrame]:
    """((spelling, city, key, entity), (rule, src, dst)): entities of venue spellings and the merges that made them.

    An entity is named by its smallest key. Extra columns of ``rows`` are ignored;
    rows without a spelling are left out; an empty table gives nothing.
    """
    work = Scratch(rows.sparkSession, "venues")
    read = work.save(read_names(rows, spelling, city, places, place_key, place_city), "read")
    edges = merge_edges(read, rows, spelling, city, work, rules)
    root = components(edges, "src", "dst").withColumnRenamed("id", "key")
    entities = read.select("spelling", "city", "key").join(root, "key", "left").select(F.col("spelling").alias(spelling), F.col("city").alias(city), "key", F.coalesce("root", "key").alias("entity"))
    return entities, edges


def fragments(c: Column) -> Column:
    """Parts of a venue cell: brackets of any kind and depth, commas, bars, semicolons and spaced dashes cut it; a Hangul name and an acronym after it are two."""
    cut = F.split(F.regexp_replace(c, r"[\s\p{Z}]+[-–—][\s\p{Z}]+", "\u001f"), r"[\x1F,，、;；|()（）\[\]［］{}]", -1)
    trimmed = F.transform(cut, lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    named = F.flatten(F.transform(trimmed, lambda x: F.when(x.rlike(r"^[가-힣][가-힣\s\d]*\s+[A-Z][A-Za-z0-9&.]{1,7}$"), F.array(F.regexp_extract(x, r"^(.*?)\s+[A-Z][A-Za-z0-9&.]{1,7}$", 1), F.regexp_extract(x, r"\s+([A-Z][A-Za-z0-9&.]{1,7})$", 1))).otherwise(F.array(x))))
    return F.filter(named, lambda x: x != "")
