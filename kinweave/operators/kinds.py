"""Kinds and channels of dated rows: a decision table for rows with a section, discovered words for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import note_value, words_of
from .joins import hot_keys, skew_left_join

#: Kinds of private sections and where their rows show, kinds of activity types, and kinds of sections of untyped rows.
PRIVATE_KIND = {"education": "education", "employment": "employment", "teaching": "teaching", "press": "publication_press", "scholarship": "funding", "service": "service"}
PRIVATE_CHANNEL = {"education": "background", "employment": "background", "teaching": "background", "press": "background", "scholarship": "hidden", "service": "hidden"}
TYPE_KIND = {
    "solo_exhibition": "solo_exhibition", "group_exhibition": "group_exhibition", "screening": "screening", "performance": "performance",
    "festival": "festival", "online_release": "online_release", "award": "award", "residency": "residency",
}
OTHER_KIND = {
    "performance": "performance", "screening": "screening", "festival": "festival", "grant": "funding", "residency": "residency",
    "commission": "commission", "workshop": "talk_workshop", "talk": "talk_workshop", "publication": "publication_press",
}
PLAIN_SECTIONS = ("exhibition", "award", "program", "project")
#: Wording of acquisitions in titles and venues, of prizes, of study grants, of private titles and of numbered sessions.
HELD_TITLE = r"(?i)소장|수집|컬렉션|collection|acquired|acquisition|permanent|ankauf|미술은행|art\s*bank|구입|매입"
HELD_VENUE = r"(?i)소장|수집|컬렉션|collection|acquired|acquisition|permanent|ankauf|구입|매입"
PLACE_OF_COLLECTION = r"(?i)\bcollection in the\b"
PRIZE, STUDY = r"(?i)\baward\b", r"(?i)grant|in support|scholarship|fellowship|stipend|장학"
PRIVATE_TITLE = r"(?i)장학금|scholarship|최우수생|peer tutoring|^review of\b|reviewer|program committee|web chair|local organiz"
SESSION = r"(?<![가-힣])회차(?![가-힣])"
#: A word tells a kind from so many rows on, where more than this share of its uses stand in the role and in one section.
LEAST_ROWS, LEAST_SHARE = 10, 0.5


def _of(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def section_of(note: Column) -> Column:
    """The ``cv_section`` token of a note, or empty."""
    return F.coalesce(F.regexp_extract(note_value(note, "cv_section"), "^([a-z_]+)$", 1), F.lit(""))


def kind_of(activity_type: Column, section: Column, title: Column, venue: Column) -> Column:
    """(kind, reason) of a row with a section, as a struct; nulls count as empty."""
    blank = F.lit("")
    a, s, t, v = (F.coalesce(c, blank) for c in (activity_type, section, title, venue))
    is_ = lambda kind, reason: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    held = t.rlike(HELD_TITLE) | (v.rlike(HELD_VENUE) & ~v.rlike(PLACE_OF_COLLECTION))
    return (
        F.when((s == "scholarship") & (a == "award") & t.rlike(PRIZE) & ~t.rlike(STUDY), is_("award", "scholarship_bare_prize"))
        .when(s.isin(*PRIVATE_KIND), is_(_of(PRIVATE_KIND, s), "private_section"))
        .when((a == "award") & (s == "grant"), is_("funding", "award_grant"))
        .when((a == "award") & (s == "project"), is_("other", "award_project"))
        .when(a.isin(*TYPE_KIND), is_(_of(TYPE_KIND, a), "type_wins"))
        .when(s.isin(*PLAIN_SECTIONS), is_("other", F.concat(F.lit("other_"), s)))
        .when((s == "collection") & held, is_("collection", "collection_lexicon"))
        .when(s == "collection", is_("other", "collection_residual"))
        .when(s.isin(*OTHER_KIND), is_(_of(OTHER_KIND, s), "other_section"))
        .otherwise(is_("other", "other_residual"))
    )


def channel_of(section: Column, title: Column, role: Column) -> Column:
    """activity, background or hidden: where a row with a section may show."""
    blank = F.lit("")
    s, text = F.coalesce(section, blank), F.concat(F.coalesce(title, blank), F.lit(" "), F.coalesce(role, blank))
    return F.when(s.isin("scholarship", "service") | text.rlike(PRIVATE_TITLE), "hidden").when(s.isin("education", "employment", "teaching", "press"), "background").otherwise("activity")


def telling_words(sectioned: DataFrame, others: DataFrame, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(word, role_n, share, section): words of ``others`` that stand in the role of ``sectioned`` rows, mostly of one private section.

    Both tables have title and role, the first a section. Ties between sections go
    to the first by name. All counts are combined on the map side.
    """
    blank = F.lit("")
    role, title = F.coalesce("role", blank), F.coalesce("title", blank)
    both = words_of(F.concat_ws(" ", role, title))
    asked = others.select(F.explode(both).alias("word")).filter(F.length("word") >= F.when(F.col("word").rlike("^[가-힣]"), 2).otherwise(3)).groupBy("word").agg(F.lit(1).alias("__one")).drop("__one")
    in_role = sectioned.select("section", F.explode(words_of(role)).alias("word")).groupBy("word", "section").agg(F.count(F.lit(1)).alias("n"))
    in_role = in_role.groupBy("word").agg(F.sum("n").alias("role_n"), F.min(F.struct((-F.col("n")).alias("m"), F.col("section"))).alias("top"))
    in_both = sectioned.select(F.explode(both).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("both_n"))
    got = in_role.join(in_both, "word").join(asked, "word", "left_semi").withColumn("share", -F.col("top.m") / F.col("role_n"))
    got = got.filter((F.col("role_n") >= least_rows) & (F.col("role_n") / F.col("both_n") > least_share) & (F.col("share") > least_share) & F.col("top.section").isin(*PRIVATE_KIND))
    return got.select("word", "role_n", "share", F.col("top.section").alias("section"))


def classify(rows: DataFrame, row_id: str, has_section: Column, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(row_id, kind, reason, channel) of every row of (activity_type, title, role, venue, reviewer_note).

    Rows with a section go by the decision table. Of the others, untyped ones go
    by the telling word with the greatest share (then most rows, then first by
    name) among those of their role, and of their title where that is Hangul or has
    none; teaching words outrule employment words, and a numbered session with a
    teaching word is a workshop. Row ids are unique; nulls count as empty.
    """
    blank = F.lit("")
    text = [F.coalesce(c, blank).alias(c) for c in ("activity_type", "title", "role", "venue")]
    base = rows.select(F.col(row_id).alias("id"), *text, section_of(F.col("reviewer_note")).alias("section"), F.coalesce(has_section, F.lit(False)).alias("own"))
    own, rest = base.filter("own"), base.filter("NOT own")
    by_table = own.select("id", kind_of(F.col("activity_type"), F.col("section"), F.col("title"), F.col("venue")).alias("k"), channel_of(F.col("section"), F.col("title"), F.col("role")).alias("channel")).select("id", "k.kind", "k.reason", "channel")
    typed = rest.filter("activity_type <> 'other'")
    known = F.col("activity_type").isin(*TYPE_KIND)
    by_type = typed.select("id", F.when(known, F.col("activity_type")).otherwise("other").alias("kind"), F.when(known, "roster_type").otherwise("roster_other").alias("reason"), F.lit("activity").alias("channel"))
    free = rest.filter("activity_type = 'other'")
    telling = telling_words(own, free, least_rows)
    no_hangul = ~F.col("title").rlike("[가-힣]")
    said = F.array_union(words_of(F.col("role")), F.filter(words_of(F.col("title")), lambda w: w.rlike("^[가-힣]") | no_hangul))
    words = free.select("id", F.explode(said).alias("word"))
    hits = skew_left_join(words, telling, "word", hot_keys(words, "word"), "inner")
    best = hits.groupBy("id").agg(F.bool_or(F.col("section") == "teaching").alias("teaches"), *[F.min(F.when(cond, F.struct((-F.col("share")).alias("a"), (-F.col("role_n")).alias("b"), F.col("word"), F.col("section")))).alias(n) for n, cond in (("first", F.lit(True)), ("no_job", F.col("section") != "employment"))])
    got = free.join(best, "id", "left").withColumn("w", F.when(F.col("teaches"), F.col("no_job")).otherwise(F.col("first")))
    session = F.coalesce("teaches", F.lit(False)) & F.concat_ws(" ", "role", "title").rlike(SESSION)
    none = F.col("w").isNull()
    kind = F.when(session, "talk_workshop").when(none, "other").otherwise(_of(PRIVATE_KIND, F.col("w.section")))
    reason = F.when(session, "roster_session").when(none, "roster_other").otherwise(F.concat(F.lit("roster_token_"), F.col("w.word")))
    channel = F.when(session | none, "activity").otherwise(_of(PRIVATE_CHANNEL, F.col("w.section")))
    by_word = got.select("id", kind.alias("kind"), reason.alias("reason"), channel.alias("channel"))
    return by_table.unionByName(by_type).unionByName(by_word).withColumnRenamed("id", row_id)
