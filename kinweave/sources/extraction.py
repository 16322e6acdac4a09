"""Model responses and tolerant JSON lines as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The row of an extraction and the types an activity may have.
ENTRY = "title string, venue string, year int, activity_type string, role string, cv_section string, upcoming boolean, source_id string, note string"
ENTRY_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


def parse_extractions(df: DataFrame, doc: str, raw: str, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): a document with one malformed or unknown entry is rejected whole.

    Rejected: text that is no JSON object with a list of activities, an entry with
    an unlisted field or type, or without a title. A null text is rejected too.
    """
    good = F.from_json(raw, f"activities array<struct<{', '.join(c.replace(' ', ':', 1) for c in ENTRY.split(', '))}>>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    loose = F.from_json(raw, "activities array<map<string,string>>")
    x = df.select(F.col(doc).alias("doc"), good.alias("g"), loose.alias("l"))
    known = F.array(*map(F.lit, ENTRY_COLUMNS))
    extra = F.exists("l.activities", lambda m: F.size(F.array_except(F.map_keys(m), known)) > 0)
    wrong = F.exists("g.activities", lambda e: ~F.coalesce(e["activity_type"].isin(*types), F.lit(False)) | (F.coalesce(F.trim(e["title"]), F.lit("")) == ""))
    bad = F.col("g").isNull() | F.col("g._corrupt").isNotNull() | F.col("g.activities").isNull() | F.coalesce(extra, F.lit(True)) | F.coalesce(wrong, F.lit(True))
    marked = x.withColumn("bad", F.coalesce(bad, F.lit(True)))
    rows = marked.filter(~F.col("bad")).select("doc", F.posexplode("g.activities").alias("pos", "e")).select("doc", "pos", "e.*")
    return rows, marked.filter("bad").select("doc")


def tag_classes(spark: SparkSession, path: str) -> DataFrame:
    """(id, classes) of JSON lines whose classes are a list, a word list, or marks set to true; ids merge."""
    raw = spark.read.schema("id string, classes string, rest string").json(path)
    return raw.select("id", F.explode(classes_of(F.col("classes"))).alias("c")).groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("classes"))


def classes_of(c: Column) -> Column:
    """Names in a JSON list, a JSON object of booleans, or a comma list."""
    listed = F.from_json(c, "array<string>")
    marks = F.from_json(c, "map<string,boolean>")
    plain = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.startswith("["), listed).when(c.startswith("{"), F.map_keys(F.map_filter(marks, lambda k, v: v))).otherwise(plain)
