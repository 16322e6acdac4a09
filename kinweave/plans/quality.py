"""Flags, depth, measures, review state and grounding as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks as ck
from ..functions.text import match_key
from ..operators import quality as ql
from ..operators import review as rv
from ..sources.tables import table as t
from .registry import query
from .ties import KEPT, KEY, YEAR, kept_activities

NOW = 2026


@query("year_flags", f"""WITH y AS (SELECT activity_id, {YEAR} AS y, title FROM activities) SELECT activity_id, list_filter([CASE WHEN y IS NULL THEN 'Y0' END, CASE WHEN NOT y BETWEEN 1900 AND {NOW + 2} THEN 'Y1' END, CASE WHEN list_contains(regexp_extract_all(title, '((?:19|20)[0-9]{{2}})\\s*[-–~]\\s*(?:19|20)?[0-9]{{2}}', 1), CAST(y AS VARCHAR)) OR list_contains(regexp_extract_all(title, '(?:19|20)[0-9]{{2}}\\s*[-–~]\\s*((?:19|20)[0-9]{{2}})', 1), CAST(y AS VARCHAR)) THEN 'Y2' END], lambda x: x IS NOT NULL) AS flags FROM y""")
def year_flags(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select("activity_id", ql.year_flags(F.col("year"), F.col("title"), NOW).alias("flags"))


@query("record_depth", """WITH n AS (SELECT ledger_id, count(*) AS n, count(DISTINCT activity_type) AS k FROM activities GROUP BY 1), m AS (SELECT ledger_id, count(*) AS m FROM frame_membership GROUP BY 1)
SELECT a.ledger_id, CASE WHEN n.n >= 20 AND n.k >= 4 THEN 4 WHEN n.n >= 5 THEN 3 WHEN n.n >= 1 THEN 2 WHEN m.m >= 1 THEN 1 END AS depth FROM artists a LEFT JOIN n ON n.ledger_id = a.ledger_id LEFT JOIN m ON m.ledger_id = a.ledger_id""")
def record_depth(s: SparkSession, d: str) -> DataFrame:
    n = t(s, d, "activities").groupBy("ledger_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("activity_type").alias("k"))
    m = t(s, d, "frame_membership").groupBy("ledger_id").agg(F.count(F.lit(1)).alias("m"))
    j = t(s, d, "artists").select("ledger_id").join(n, "ledger_id", "left").join(m, "ledger_id", "left")
    return j.select("ledger_id", ql.depth([(4, (F.col("n") >= 20) & (F.col("k") >= 4)), (3, F.col("n") >= 5), (2, F.col("n") >= 1), (1, F.col("m") >= 1)]).alias("depth"))


@query("active_since", f"WITH {KEPT} SELECT ledger_id, y AS year, activity_id FROM (SELECT ledger_id, year AS y, activity_id, row_number() OVER (PARTITION BY ledger_id ORDER BY year, activity_id) AS k FROM kept) WHERE k = 1")
def active_since(s: SparkSession, d: str) -> DataFrame:
    return ql.first_evidence(kept_activities(s, d), "ledger_id", "year", "activity_id")


@query("medium_tags", "WITH x AS (SELECT ledger_id, activity_id, unnest(list_filter([CASE WHEN regexp_matches(lower(title), 'light|빛') THEN 'light' END, CASE WHEN regexp_matches(lower(title), 'sound|소리|bell') THEN 'sound' END, CASE WHEN regexp_matches(lower(title), 'machine|기계|engine') THEN 'machine' END], lambda x: x IS NOT NULL)) AS tag FROM activities) SELECT ledger_id, tag, count(*) AS rows, min(activity_id) AS first_row FROM x GROUP BY 1, 2 HAVING count(*) >= 2")
def medium_tags(s: SparkSession, d: str) -> DataFrame:
    return ql.tags_with_rows(t(s, d, "activities"), "ledger_id", "activity_id", F.lower("title"), [("light", "light|빛"), ("sound", "sound|소리|bell"), ("machine", "machine|기계|engine")])


@query("entity_measures", f"WITH {KEPT} SELECT ledger_id, count(*) AS n, round(CAST(count(*) FILTER (activity_type = 'solo_exhibition') AS DOUBLE) / count(*), 9) AS share_solo, round(CAST(count(*) FILTER (activity_type = 'group_exhibition') AS DOUBLE) / count(*), 9) AS share_group, round(CAST(count(*) FILTER (year >= 2015) AS DOUBLE) / count(*), 9) AS share_recent, round(CAST(count(*) FILTER (starts_with(origin, 'cv:')) AS DOUBLE) / count(*), 9) AS share_own, count(DISTINCT venue) AS n_venues, count(DISTINCT year) AS n_years FROM kept GROUP BY 1")
def entity_measures(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("activity_type")
    return ql.measures(kept_activities(s, d), "ledger_id", {"solo": kind == "solo_exhibition", "group": kind == "group_exhibition", "recent": F.col("year") >= 2015, "own": F.col("origin").startswith("cv:")}, {"venues": F.col("venue"), "years": F.col("year")})


@query("capped_id_lists", "WITH g AS (SELECT affiliation, list_sort(list_distinct(list(ledger_id))) AS v FROM artists WHERE affiliation IS NOT NULL GROUP BY 1) SELECT affiliation, array_to_string(list_slice(v, 1, 3), '|') || CASE WHEN len(v) > 3 THEN '|+' || CAST(len(v) - 3 AS VARCHAR) ELSE '' END AS ids FROM g")
def capped_id_lists(s: SparkSession, d: str) -> DataFrame:
    return ql.capped_lists(t(s, d, "artists"), "affiliation", "ledger_id", 3)


@query("review_sync", "WITH w AS (SELECT DISTINCT ledger_id FROM artists WHERE verification = 'UNVERIFIED'), o AS (SELECT DISTINCT ledger_id FROM artists WHERE name_en IS NULL) SELECT coalesce(w.ledger_id, o.ledger_id) AS ledger_id, CASE WHEN o.ledger_id IS NULL THEN 'open' WHEN w.ledger_id IS NULL THEN 'close' ELSE 'keep' END AS action FROM w FULL JOIN o ON w.ledger_id = o.ledger_id")
def review_sync(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "artists")
    return rv.sync(a.filter("verification = 'UNVERIFIED'"), a.filter("name_en IS NULL"), ["ledger_id"])


@query("superseded_rows", f"WITH x AS (SELECT *, {KEY.format('title')} AS k FROM activities), b AS (SELECT DISTINCT ledger_id, k, year FROM x WHERE source_type = 'PUBLIC_RECORD') SELECT x.activity_id, b.k IS NOT NULL AND coalesce(x.source_type <> 'PUBLIC_RECORD', true) AS superseded FROM x LEFT JOIN b ON x.ledger_id = b.ledger_id AND x.k = b.k AND x.year = b.year")
def superseded_rows(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "activities").select("activity_id", "ledger_id", match_key(F.col("title")).alias("k"), "year", "source_type")
    return rv.superseded(x, ["ledger_id", "k", "year"], "source_type", "PUBLIC_RECORD").select("activity_id", "superseded")


@query("paired_ids", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY region, field ORDER BY ledger_id) AS n FROM artists WHERE verification = 'UNVERIFIED'), w AS (SELECT *, row_number() OVER (PARTITION BY region, field ORDER BY ledger_id) AS n, count(*) OVER (PARTITION BY region, field) AS c FROM artists WHERE verification = 'VERIFIED'), c AS (SELECT DISTINCT region, field, c FROM w) SELECT o.ledger_id AS old_id, w.ledger_id AS new_id FROM o JOIN c ON o.region = c.region AND o.field = c.field JOIN w ON w.region = o.region AND w.field = o.field AND w.n = least(o.n, c.c) WHERE o.ledger_id <> w.ledger_id")
def paired_ids(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "artists").select("region", "field", "ledger_id", "verification")
    old = a.filter("verification = 'UNVERIFIED'").select("region", "field", F.col("ledger_id").alias("old_id"))
    return rv.paired_changes(old, a.filter("verification = 'VERIFIED'").select("region", "field", F.col("ledger_id").alias("new_id")), ["region", "field"], "old_id", "new_id")


@query("version_rows", """WITH r AS (SELECT gy_id, name_ko, name_en, affiliation, row_number() OVER (PARTITION BY gy_id ORDER BY collected_at, ledger_id) AS a, row_number() OVER (PARTITION BY gy_id ORDER BY collected_at DESC, ledger_id DESC) AS z FROM artists WHERE gy_id IS NOT NULL AND trim(gy_id) <> '' AND collected_at IS NOT NULL)
SELECT n.gy_id, n.name_ko, n.name_en, n.affiliation, 2 AS version FROM (SELECT * FROM r WHERE z = 1) n JOIN (SELECT * FROM r WHERE a = 1) o USING (gy_id) WHERE n.name_ko IS DISTINCT FROM o.name_ko OR n.name_en IS DISTINCT FROM o.name_en OR n.affiliation IS DISTINCT FROM o.affiliation""")
def version_rows(s: SparkSession, d: str) -> DataFrame:
    """Second versions: published ids whose latest row says something else than their first."""
    content = ["name_ko", "name_en", "affiliation"]
    a = t(s, d, "artists").filter("gy_id IS NOT NULL AND trim(gy_id) <> '' AND collected_at IS NOT NULL")
    row, at = F.struct(*content), F.struct("collected_at", "ledger_id")
    ends = a.groupBy("gy_id").agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))
    none = s.createDataFrame([], "gy_id string, version int, digest string")
    history = rv.version_rows(none, ends.select("gy_id", "first.*"), ["gy_id"], content, F.lit("2025-01-01"))
    return rv.version_rows(history, ends.select("gy_id", "last.*"), ["gy_id"], content, F.lit("2026-01-01")).select("gy_id", *content, "version")


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


@query("ungrounded_rows", f"""WITH w AS (SELECT DISTINCT ledger_id, unnest({WORDS.format("text")}) AS word FROM documents WHERE text IS NOT NULL AND ledger_id IS NOT NULL), p AS (SELECT DISTINCT ledger_id FROM w),
x AS (SELECT activity_id, ledger_id, unnest({WORDS.format("title")}) AS word FROM activities WHERE ledger_id IN (SELECT ledger_id FROM p))
SELECT x.activity_id, count(*) AS words, count(*) FILTER (w.word IS NULL) AS missing FROM x LEFT JOIN w ON w.ledger_id = x.ledger_id AND w.word = x.word GROUP BY 1 HAVING count(*) FILTER (w.word IS NULL) > 0""")
def ungrounded_rows(s: SparkSession, d: str) -> DataFrame:
    """Activities of people with texts of which some title word stands in none of them."""
    docs = t(s, d, "documents").filter("text IS NOT NULL AND ledger_id IS NOT NULL")
    return ql.missing_words(t(s, d, "activities"), docs, "activity_id", "ledger_id", "title", "text")


@query("text_pieces")
def text_pieces(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(ck.split_text(F.col("text"), 1000)).alias("pos", "piece"))
    return x.select("doc_id", "pos", F.length("piece").alias("n_chars"))
