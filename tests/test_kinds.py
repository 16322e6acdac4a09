import pytest
from pyspark.sql import functions as F

from kinweave.operators import kinds as kd

from .conftest import rows


@pytest.mark.parametrize("row,want", [
    (("award", "scholarship", "Best Award", ""), ("award", "scholarship_bare_prize")),
    (("award", "scholarship", "Award scholarship", ""), ("funding", "private_section")),
    (("solo_exhibition", "press", "", ""), ("publication_press", "private_section")),
    (("award", "grant", "", ""), ("funding", "award_grant")),
    (("award", "project", "", ""), ("other", "award_project")),
    (("screening", "exhibition", "", ""), ("screening", "type_wins")),
    (("other", "exhibition", "", ""), ("other", "other_exhibition")),
    (("other", "collection", "소장품", ""), ("collection", "collection_lexicon")),
    (("other", "collection", "", "A collection in the park"), ("other", "collection_residual")),
    (("other", "talk", "", ""), ("talk_workshop", "other_section")),
    (("other", "", None, None), ("other", "other_residual")),
])
def test_decision_table(spark, row, want):
    df = spark.createDataFrame([row], "a string, s string, t string, v string")
    got = df.select(kd.kind_of(F.col("a"), F.col("s"), F.col("t"), F.col("v")).alias("k")).first()["k"]
    assert tuple(got) == want


def test_words_found_in_one_table_name_the_kinds_of_the_other(spark):
    data = [(f"c{i}", "other", f"title {i}", "강사 lecturer", "", "cv_section=teaching", "cv:1") for i in range(12)]
    data += [(f"e{i}", "other", "x", "연구원", "", "note; cv_section=employment", "cv:1") for i in range(11)]
    data += [("r1", "other", "강사 모임", None, "", None, "AB"), ("r2", "other", "", "연구원, 강사", "", None, "AB"), ("r3", "other", "강사 회차", "", "", None, "AB"), ("r4", "other", "연구원실", "", "", None, None)]
    data += [("r5", "screening", "", "강사", "", None, "AB"), ("r6", "talk", "", "", "", None, "AB"), ("r7", "other", "한글 lecturer", "", "", None, "AB"), ("r8", "other", "The lecturer", "", "", None, "AB"), ("r9", None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "activity_id string, activity_type string, title string, role string, venue string, reviewer_note string, origin string")
    got = {r[0]: tuple(r[1:]) for r in rows(kd.classify(df, "activity_id", F.col("origin").startswith("cv:")), "activity_id", "kind", "reason", "channel")}
    assert len(got) == len(data) and got["c1"] == ("teaching", "private_section", "background") and got["e1"][2] == "background"
    assert got["r1"] == ("teaching", "roster_token_강사", "background") and got["r2"] == ("teaching", "roster_token_강사", "background")
    assert got["r3"] == ("talk_workshop", "roster_session", "activity") and got["r4"] == ("other", "roster_other", "activity")
    assert got["r5"] == ("screening", "roster_type", "activity") and got["r6"] == ("other", "roster_other", "activity")
    assert got["r7"][1] == "roster_other" and got["r8"][0] == "teaching" and got["r9"] == ("other", "roster_other", "activity")
    assert kd.classify(df.limit(0), "activity_id", F.col("origin").startswith("cv:")).count() == 0
