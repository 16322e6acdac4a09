"""Record queries: merging, versions, matching, sequences, ids, redirects and groups by shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import code_family
from ..functions.text import hangul_compact, match_key, script_of, uuid5
from ..operators import components as cc
from ..operators import merge as mg
from ..operators import sequences as sq
from ..operators.joins import hub_join
from ..sources.tables import table as t
from .registry import query
from .ties import KEY

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query("latest_version", "SELECT gy_id, ledger_id, affiliation, epoch_us(collected_at) AS collected_us FROM (SELECT *, row_number() OVER (PARTITION BY gy_id ORDER BY collected_at DESC NULLS LAST, ledger_id DESC) AS k FROM artists WHERE gy_id IS NOT NULL) WHERE k = 1")
def latest_version(s: SparkSession, d: str) -> DataFrame:
    return mg.latest(t(s, d, "artists").filter("gy_id IS NOT NULL"), ["gy_id"], [F.col("collected_at"), F.col("ledger_id")], ["ledger_id", "affiliation", "collected_at"]).select("gy_id", "ledger_id", "affiliation", F.unix_micros("collected_at").alias("collected_us"))


@query("first_wins_dedupe", f"""WITH x AS (SELECT *, {KEY.format('title')} AS tk, {KEY.format('venue')} AS vk FROM activities) SELECT activity_id, ledger_id, title, rows FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, tk, vk, trim(year) ORDER BY activity_id) AS k, count(*) OVER (PARTITION BY ledger_id, tk, vk, trim(year)) AS rows FROM x) WHERE k = 1""")
def first_wins_dedupe(s: SparkSession, d: str) -> DataFrame:
    return mg.first_wins(t(s, d, "activities"), [F.col("ledger_id"), match_key(F.col("title")), match_key(F.col("venue")), F.trim("year")], [F.col("activity_id")], ["activity_id", "ledger_id", "title"])


@query("tiered_match", """WITH l AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), r AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS seg FROM supplier),
a AS (SELECT s_nationkey, seg, min(s_suppkey) AS m FROM r GROUP BY 1, 2), b AS (SELECT s_nationkey, min(s_suppkey) AS m FROM r GROUP BY 1)
SELECT c_custkey, coalesce(a.m, b.m) AS s_suppkey, CASE WHEN a.m IS NOT NULL THEN 'nation and segment' ELSE 'nation' END AS tier FROM l LEFT JOIN a ON a.s_nationkey = c_nationkey AND a.seg = c_mktsegment LEFT JOIN b ON b.s_nationkey = c_nationkey WHERE coalesce(a.m, b.m) IS NOT NULL""")
def tiered_match(s: SparkSession, d: str) -> DataFrame:
    left = t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    right = t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") > 0, "BUILDING").otherwise("MACHINERY").alias("segment"))
    return mg.tiered_match(left, right, "c_custkey", "s_suppkey", [("nation and segment", ["nation", "segment"]), ("nation", ["nation"])])


@query("upsert_fill", """WITH n AS (SELECT ledger_id, min(nullif(role, '')) AS note FROM activities WHERE ledger_id IS NOT NULL GROUP BY 1), o AS (SELECT ledger_id, reviewer_note AS note FROM artists)
SELECT coalesce(o.ledger_id, n.ledger_id) AS ledger_id, CASE WHEN o.ledger_id IS NULL THEN n.note ELSE coalesce(nullif(o.note, ''), n.note) END AS note, CASE WHEN o.ledger_id IS NULL THEN 'added' WHEN n.ledger_id IS NOT NULL THEN 'matched' ELSE 'kept' END AS how FROM o FULL JOIN n ON o.ledger_id = n.ledger_id""")
def upsert_fill(s: SparkSession, d: str) -> DataFrame:
    new = t(s, d, "activities").filter("ledger_id IS NOT NULL").select("ledger_id", F.col("role").alias("note"))
    return mg.upsert(t(s, d, "artists").select("ledger_id", F.col("reviewer_note").alias("note")), new, ["ledger_id"], ["note"])


@query("insert_absent", "SELECT DISTINCT id AS ledger_id FROM (SELECT kept AS id FROM merge_records UNION ALL SELECT dropped FROM merge_records) WHERE id IS NOT NULL AND id NOT IN (SELECT ledger_id FROM artists WHERE ledger_id IS NOT NULL)")
def insert_absent(s: SparkSession, d: str) -> DataFrame:
    """Merged ids the table of artists lacks."""
    ids = t(s, d, "merge_records").select(F.explode(F.array("kept", "dropped")).alias("ledger_id")).filter("ledger_id IS NOT NULL")
    return mg.insert_absent(t(s, d, "artists").select("ledger_id"), ids, ["ledger_id"])


@query("membership_dedupe", "SELECT ledger_id, frame_code, min(attach_rule) AS attach_rule, count(*) AS rows FROM frame_membership WHERE ledger_id IS NOT NULL AND frame_code IS NOT NULL GROUP BY 1, 2")
def membership_dedupe(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "frame_membership").filter("ledger_id IS NOT NULL AND frame_code IS NOT NULL")
    return m.groupBy("ledger_id", "frame_code").agg(F.min("attach_rule").alias("attach_rule"), F.count(F.lit(1)).alias("rows"))


@query("mutual_unique_match", """WITH l AS (SELECT c_nationkey AS k, CAST(round(c_acctbal / 100) AS BIGINT) AS b, count(*) AS n, min(c_custkey) AS c FROM customer GROUP BY 1, 2), r AS (SELECT s_nationkey AS k, CAST(round(s_acctbal / 100) AS BIGINT) AS b, count(*) AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1, 2)
SELECT l.c AS c_custkey, r.s AS s_suppkey FROM l JOIN r USING (k, b) WHERE l.n = 1 AND r.n = 1""")
def mutual_unique_match(s: SparkSession, d: str) -> DataFrame:
    left = t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.round(F.col("c_acctbal") / 100).cast("long").alias("b"))
    right = t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.round(F.col("s_acctbal") / 100).cast("long").alias("b"))
    return mg.mutual_unique(left, right, "c_custkey", "s_suppkey", ["k", "b"])


@query("allocated_ids", "SELECT ledger_id, 'GY-' || lpad(CAST((SELECT coalesce(max(CAST(regexp_extract(gy_id, '([0-9]+)$', 1) AS BIGINT)), 0) FROM artists WHERE gy_id IS NOT NULL) + row_number() OVER (ORDER BY ledger_id) AS VARCHAR), 9, '0') AS new_id FROM artists WHERE gy_id IS NULL")
def allocated_ids(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "artists")
    issued = a.filter("gy_id IS NOT NULL").select(F.regexp_extract("gy_id", r"([0-9]+)$", 1).cast("long").alias("n"))
    return mg.allocate_ids(a.filter("gy_id IS NULL").select("ledger_id"), issued, "n", ["ledger_id"], "GY-", 9)


@query("gap_ids", "WITH n AS (SELECT DISTINCT CAST(regexp_extract(gy_id, '([0-9]+)$', 1) AS BIGINT) AS x FROM artists WHERE gy_id IS NOT NULL), l AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM n) SELECT x AS after, nx - x - 1 AS gap FROM l WHERE nx - x > 1")
def gap_ids(s: SparkSession, d: str) -> DataFrame:
    return mg.missing_numbers(t(s, d, "artists").filter("gy_id IS NOT NULL").select(F.regexp_extract("gy_id", r"([0-9]+)$", 1).cast("long").alias("n")), "n")


@query("redirect_chain", """WITH RECURSIVE r AS (SELECT o_custkey AS o, CAST(max(c) AS BIGINT) AS n FROM (SELECT c_custkey AS o_custkey, c_custkey // 3 AS c FROM customer) GROUP BY 1 HAVING max(c) > 0), w AS (SELECT o, n, 1 AS k FROM r UNION ALL SELECT w.o, r.n, k + 1 FROM w JOIN r ON w.n = r.o WHERE k < 60)
SELECT o AS retired, min(n) AS final FROM w GROUP BY 1""")
def redirect_chain(s: SparkSession, d: str) -> DataFrame:
    r = t(s, d, "customer").select(F.col("c_custkey").alias("retired"), F.floor(F.col("c_custkey") / 3).alias("kept")).filter("kept > 0")
    return cc.follow(r, "retired", "kept")


GROUP_SQL = f"""WITH RECURSIVE k AS (SELECT ledger_id AS id, {KEY.format('name_en')} AS key FROM artists WHERE {KEY.format('name_en')} <> ''), hub AS (SELECT key, min(id) AS h FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT k.id, hub.h AS root FROM k JOIN hub USING (key)"""


@query("shared_name_groups", GROUP_SQL)
def shared_name_groups(s: SparkSession, d: str) -> DataFrame:
    """Rows of equal name key as groups: each row once with its group, no pair is listed."""
    k = t(s, d, "artists").select(F.col("ledger_id").alias("id"), match_key(F.col("name_en")).alias("key")).filter("key <> ''")
    hub = k.groupBy("key").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "root")
    return hub_join(k, hub, "key", "inner").select("id", "root")


COMPONENTS = rf"""WITH RECURSIVE k AS (SELECT id, key FROM (SELECT ledger_id AS id, unnest(['k:' || array_to_string(regexp_extract_all(name_ko, '[가-힣]+'), ''), 'e:' || {KEY.format("name_en")}, 'g:' || gy_id]) AS key FROM artists) WHERE length(key) > 2), h AS (SELECT key, min(id) AS h FROM k GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT k.id AS a, h.h AS b FROM k JOIN h USING (key) WHERE k.id <> h.h UNION SELECT h.h, k.id FROM k JOIN h USING (key) WHERE k.id <> h.h), r(id, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id WHERE r.g < e.b) SELECT id, min(g) AS root FROM r GROUP BY 1"""


@query("connected_components", COMPONENTS)
def connected_components(s: SparkSession, d: str) -> DataFrame:
    """Artists connected by equal Hangul or Latin name keys or a published id, over star edges."""
    a = t(s, d, "artists")
    keys = F.explode(F.array(F.concat(F.lit("k:"), hangul_compact(F.col("name_ko"))), F.concat(F.lit("e:"), match_key(F.col("name_en"))), F.concat(F.lit("g:"), F.col("gy_id"))))
    e = a.select(F.col("ledger_id").alias("id"), keys.alias("key")).filter("length(key) > 2")
    hub = e.groupBy("key").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cc.components(hub_join(e, hub, "key", "inner").select("id", "root"), "id", "root")


@query("script_name_keys", f"SELECT ledger_id, CASE WHEN regexp_matches(coalesce(nullif(name_ko, ''), name_en), '[가-힣]') THEN 'hangul' WHEN regexp_matches(coalesce(nullif(name_ko, ''), name_en), '[A-Za-z]') THEN 'latin' ELSE '' END AS script, {KEY.format('coalesce(nullif(name_ko, %s), name_en)' % repr(''))} AS key FROM artists")
def script_name_keys(s: SparkSession, d: str) -> DataFrame:
    n = mg.filled(F.col("name_ko"), F.col("name_en"))
    return t(s, d, "artists").select("ledger_id", script_of(n).alias("script"), match_key(n).alias("key"))


@query("uuid5_ids")
def uuid5_ids(s: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("\u001f", "ledger_id", match_key(F.col("title")), "year", match_key(F.col("venue")))
    return t(s, d, "activities").select("activity_id", uuid5(key, NAMESPACE).alias("uuid"))


@query("ordinal_ids", "SELECT activity_id, ledger_id, row_number() OVER (PARTITION BY ledger_id, title, venue, year ORDER BY activity_id) - 1 AS ordinal FROM activities")
def ordinal_ids(s: SparkSession, d: str) -> DataFrame:
    return sq.ordinals(t(s, d, "activities").select("activity_id", "ledger_id", "title", "venue", "year"), ["ledger_id", "title", "venue", "year"], ["activity_id"]).select("activity_id", "ledger_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("topk_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(s: SparkSession, d: str) -> DataFrame:
    return sq.top_per_group(t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("top_entities", "SELECT venue, n FROM (SELECT venue, count(*) AS n FROM activities WHERE venue IS NOT NULL GROUP BY 1) ORDER BY n DESC, venue LIMIT 40")
def top_entities(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").filter("venue IS NOT NULL").groupBy("venue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "venue").limit(40)


@query("boundary_pairs", "SELECT n_name, coalesce(lead(n_name) OVER (ORDER BY n_regionkey, n_name), first_value(n_name) OVER (ORDER BY n_regionkey, n_name)) AS following FROM nation")
def boundary_pairs(s: SparkSession, d: str) -> DataFrame:
    return sq.boundaries(t(s, d, "nation"), ["n_regionkey", "n_name"], "n_name")


@query("gaps_islands_runs", "WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM a) SELECT user_id, event_type, epoch_us(min(ts)) AS start, count(*) AS length FROM b GROUP BY user_id, event_type, r")
def gaps_islands_runs(s: SparkSession, d: str) -> DataFrame:
    return sq.runs(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").withColumn("start", F.unix_micros(F.col("start").cast("timestamp")))


@query("band_join_pm1", "SELECT l_orderkey, l_linenumber, o_orderkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS x FROM lineitem) l JOIN (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS y FROM orders) o ON l.l_partkey = o.o_custkey AND abs(x - y) <= 1")
def band_join_pm1(s: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_diff(F.to_date(c), F.to_date(F.lit("1992-01-01")))
    a = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), day("l_shipdate").alias("x"))
    b = t(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), day("o_orderdate").alias("y"))
    return sq.band_join(a, b, ["k"], "x", "y", 1).select("l_orderkey", "l_linenumber", "o_orderkey")


PREFIXES = ("PROMO", "PROMO BURNISHED", "ECONOMY", "ECONOMY ANODIZED", "STANDARD", "SMALL")


@query("longest_prefix_join", f"WITH p AS (SELECT unnest({list(PREFIXES)!r}) AS p) SELECT p_partkey, p_type, (SELECT max(p) FROM p WHERE starts_with(p_type, p)) AS matched FROM part")
def longest_prefix_join(s: SparkSession, d: str) -> DataFrame:
    listed = s.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    return sq.longest_prefix(t(s, d, "part").select("p_partkey", "p_type"), "p_type", listed, "prefix", max(map(len, PREFIXES)))


PATTERNS = [("solo", "solo|개인"), ("group", "group|단체"), ("stage", "performance|screening")]


@query("first_pattern_match", "SELECT activity_id, CASE WHEN regexp_matches(activity_type, 'solo|개인') THEN 'solo' WHEN regexp_matches(activity_type, 'group|단체') THEN 'group' WHEN regexp_matches(activity_type, 'performance|screening') THEN 'stage' ELSE 'other' END AS kind FROM activities")
def first_pattern_match(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select("activity_id", sq.first_pattern(F.col("activity_type"), PATTERNS, "other").alias("kind"))


@query("published_filter", """SELECT a.ledger_id FROM artists a WHERE coalesce(a.status, '') NOT IN ('HIDDEN', 'HIDDEN_BY_REQUEST', 'RETIRED') AND EXISTS (SELECT 1 FROM frame_membership m WHERE m.ledger_id = a.ledger_id) AND a.gy_id IS NOT NULL AND (starts_with(coalesce(nullif(a.source_url, ''), (SELECT min(m.source_url) FROM frame_membership m WHERE m.ledger_id = a.ledger_id AND starts_with(m.source_url, 'http'))), 'http'))""")
def published_filter(s: SparkSession, d: str) -> DataFrame:
    """Rows on a roster, not hidden, with a published id and a source, their own or their roster's."""
    m = t(s, d, "frame_membership").filter("ledger_id IS NOT NULL").groupBy("ledger_id").agg(F.min(F.when(F.col("source_url").startswith("http"), F.col("source_url"))).alias("roster_url"))
    a = t(s, d, "artists").filter(~F.coalesce("status", F.lit("")).isin("HIDDEN", "HIDDEN_BY_REQUEST", "RETIRED") & F.col("gy_id").isNotNull())
    return a.join(m, "ledger_id").filter(mg.filled(F.col("source_url"), F.col("roster_url")).startswith("http")).select("ledger_id")


@query("split_pipe_explode", r"SELECT ledger_id, pos, item FROM (SELECT ledger_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS item FROM (SELECT ledger_id, list_filter(list_transform(string_split(aliases, '|'), lambda x: trim(x, ' ')), lambda x: x <> '') AS v FROM artists WHERE aliases IS NOT NULL))")
def split_pipe_explode(s: SparkSession, d: str) -> DataFrame:
    from ..functions.text import split_pipe

    return t(s, d, "artists").select("ledger_id", F.posexplode(split_pipe(F.col("aliases"))).alias("p", "item")).select("ledger_id", F.col("p").cast("long").alias("pos"), "item")


@query("family_members", "SELECT regexp_replace(frame_code, '-[0-9]{4}$', '') AS family, list_sort(list_distinct(list(frame_code))) AS editions, count(DISTINCT ledger_id) AS members FROM frame_membership WHERE frame_code IS NOT NULL GROUP BY 1")
def family_members(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "frame_membership").filter("frame_code IS NOT NULL")
    return m.groupBy(code_family(F.col("frame_code")).alias("family")).agg(F.array_sort(F.collect_set("frame_code")).alias("editions"), F.countDistinct("ledger_id").alias("members"))
