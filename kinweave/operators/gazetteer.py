"""Places by name: one lookup table from reference lists, and fragments resolved to city, country and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.split import trimmed
from .joins import hot_keys, skew_left_join

#: Regions published for first-level divisions of the home country, and its divisions' names.
HOME = "KR"
REGIONS = {"11": "서울", "13": "경기", "12": "경기", "10": "부산", "15": "대구", "18": "광주", "19": "대전"}
OTHER_REGION = "기타"
DIVISIONS = {
    "서울": "11", "경기": "13", "인천": "12", "부산": "10", "대구": "15", "광주": "18", "대전": "19", "울산": "21", "세종": "22", "강원": "06", "충북": "05", "충청북": "05",
    "충남": "17", "충청남": "17", "전북": "03", "전라북": "03", "전남": "16", "전라남": "16", "경북": "14", "경상북": "14", "경남": "20", "경상남": "20", "제주": "01",
}
#: Short names of countries that lists leave out.
SHORT_COUNTRIES = {"korea": "KR", "한국": "KR", "uk": "GB", "england": "GB", "scotland": "GB", "holland": "NL", "the netherlands": "NL", "the us": "US", "the usa": "US", "the united states": "US"}
LATIN_UNIT = r"(?i)-(?:si|gun|gu|do|eup)$"
HANGUL_UNIT = r"(특별시|광역시|특별자치시|특별자치도|시|도|군|구)$"
ABBREVIATION = r"^[A-Z]{2,3}\.?$"


def place_key(c: Column) -> Column:
    """Lower case, without signs around it, runs of space to one."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), r"^[.,;:()\[\]\"']+|[.,;:()\[\]\"']+$", ""), r"[\s\p{Z}]+", " ")


def name_variants(c: Column) -> Column:
    """A name with and without its administrative ending, and the same without hyphens."""
    bare = F.regexp_replace(c, LATIN_UNIT, "")
    flat = lambda x: F.replace(x, F.lit("-"), F.lit(""))
    return F.array_distinct(F.filter(F.array(c, bare, flat(c), flat(bare)), lambda x: x != ""))


def region_of(country: Column, admin1: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])
    return F.when(country == HOME, F.coalesce(F.element_at(table, admin1), F.lit(OTHER_REGION))).otherwise("")


def place_table(cities: DataFrame, countries: DataFrame | None = None, admin1: DataFrame | None = None) -> DataFrame:
    """(key, city, country, region), one row per key.

    ``cities`` has name, population, country, admin1 and canonical, ``countries``
    name and code, ``admin1`` name, country and region. Of equal keys a division of
    the home country comes first, then the most populous city (ties: the first
    canonical), then a division elsewhere, then a country. Keys of one letter and
    rows without a name or country are left out.
    """
    spark = cities.sparkSession
    c = cities.filter(F.col("name").isNotNull() & F.col("country").isNotNull()).select(F.explode(name_variants(F.col("name"))).alias("n"), F.coalesce(F.col("population").cast("long"), F.lit(0)).alias("population"), "country", F.coalesce("admin1", F.lit("")).alias("admin1"), F.coalesce("canonical", "name").alias("city"))
    c = c.select(place_key(F.col("n")).alias("key"), F.struct(F.lit(1).alias("p"), (-F.col("population")).alias("q"), "city", "country", "admin1").alias("r"))
    row = lambda p, country, region: F.struct(F.lit(p).alias("p"), F.lit(0).cast("long").alias("q"), F.lit("").alias("city"), country.alias("country"), region.alias("admin1"))
    home = spark.createDataFrame(list(DIVISIONS.items()), "key string, a string").select("key", row(0, F.lit(HOME), F.col("a")).alias("r"))
    short = spark.createDataFrame(list(SHORT_COUNTRIES.items()), "key string, c string").select("key", row(3, F.col("c"), F.lit("")).alias("r"))
    every = c.unionByName(home).unionByName(short)
    if countries is not None:
        every = every.unionByName(countries.select(place_key(F.col("name")).alias("key"), row(4, F.col("code"), F.lit("")).alias("r")))
    best = every.filter(F.length("key") >= 2).groupBy("key").agg(F.min("r").alias("r"), F.min(F.when(F.col("r.p") == 1, F.col("r"))).alias("c"))
    # a home division that is also a city of that division keeps the city's name
    same = (F.col("r.p") == 0) & (F.col("c.country") == HOME) & (F.col("c.admin1") == F.col("r.admin1"))
    city = F.when(F.coalesce(same, F.lit(False)), F.col("c.city")).otherwise(F.col("r.city"))
    got = best.select("key", city.alias("city"), F.col("r.country").alias("country"), F.when(F.col("r.p") == 3, "").otherwise(region_of(F.col("r.country"), F.col("r.admin1"))).alias("region"), F.col("r.p").alias("p"))
    got = got.select("key", "city", "country", F.when(F.col("p") >= 3, "").otherwise(F.col("region")).alias("region"))
    if admin1 is not None:
        a = admin1.select(place_key(F.col("name")).alias("key"), "country", "region").filter(F.length("key") >= 2).groupBy("key").agg(F.min(F.struct("country", "region")).alias("a"))
        j = got.join(a, "key", "full")
        swap = F.col("a").isNotNull() & (F.col("country").isNull() | ((F.col("city") == "") & (F.col("region") == "")))
        got = j.select("key", F.coalesce("city", F.lit("")).alias("city"), F.when(swap, F.col("a.country")).otherwise(F.col("country")).alias("country"), F.when(swap, F.col("a.region")).otherwise(F.col("region")).alias("region"))
    return got


def resolve_fragments(cells: DataFrame, row_id: str, fragments: Column, table: DataFrame, codes: dict[str, str]) -> DataFrame:
    """(row_id, pos, fragment, city, country, region) of the fragments of a cell that name a place.

    ``codes`` maps two- and three-letter country codes in capitals to the country;
    it is bounded by the number of countries. A code names its country; a name is
    looked up, then without its administrative ending. An abbreviation right after
    a place is a part of it, so it only repeats the country (and the region at
    home). Row ids are unique; null cells name nothing.
    """
    x = cells.select(F.col(row_id).alias("__i"), F.posexplode(fragments).alias("pos", "fragment")).filter("fragment IS NOT NULL")
    x = x.select("__i", F.expr("pos + 1").alias("pos"), trimmed(F.col("fragment")).alias("fragment")).withColumn("key", place_key(F.col("fragment")))
    x = x.withColumn("bare", F.regexp_replace("key", HANGUL_UNIT, "")).withColumn("code", F.element_at(F.create_map(*[F.lit(v) for kv in codes.items() for v in kv]), F.regexp_extract("fragment", r"^([A-Z]{2,3})\.?$", 1)))
    hit = table.select("key", F.struct("city", "country", "region").alias("h1"))
    x = skew_left_join(x, hit, "key", hot_keys(x, "key"))
    x = skew_left_join(x, hit.select(F.col("key").alias("bare"), F.col("h1").alias("h2")), "bare", hot_keys(x, "bare"))
    by_code = F.when(F.col("code").isNotNull(), F.struct(F.lit("").alias("city"), F.col("code").alias("country"), F.lit("").alias("region")))
    x = x.select("__i", "pos", "fragment", F.coalesce(by_code, "h1", "h2").alias("own"), F.col("fragment").rlike(ABBREVIATION).alias("abbr"))
    w = Window.partitionBy("__i").orderBy("pos")
    x = x.withColumn("run", F.sum(F.when(F.col("abbr"), 0).otherwise(1)).over(w))
    run = Window.partitionBy("__i", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("src", F.first(F.when(F.col("own").isNotNull(), F.struct("pos", "own")), ignorenulls=True).over(run))
    home_region = F.when(F.col("src.own.country") == HOME, F.col("src.own.region")).otherwise("")
    inherited = F.when(F.col("abbr") & (F.col("src.pos") < F.col("pos")), F.struct(F.lit("").alias("city"), F.col("src.own.country").alias("country"), home_region.alias("region")))
    got = x.withColumn("h", F.coalesce(inherited, "own")).filter("h IS NOT NULL")
    return got.select(F.col("__i").alias(row_id), "pos", "fragment", "h.city", "h.country", "h.region")
