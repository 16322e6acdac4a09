import random

import pytest

from kinweave.llm import names
from kinweave.llm.names import UNIT, clusters, confirmed, edits, forms_of, row_forms, same_entities, variant_pairs

from ..conftest import rows

COLS = "ledger_id string, gy_id string, name_ko string, name_en string, aliases string, active_since string, region string, field string, block string, forms string"


def artists(spark, data):
    return spark.createDataFrame([(i, g, ko, en, al, *(attrs or ("2000", "R", "F")), "x", "y") for i, g, ko, en, al, attrs in data], COLS)


@pytest.mark.parametrize("a,b", [("이유종", "Yoo Jong Lee"), ("조윤경", "Cho Yunkyeonk"), ("김은근", "KIM Eun-geun"), ("Frederik A. Delzaski", "Delzaski, F."), ("Robert Rosseski", "Bob Rosseski"), ("Halteo Collective", "HALTEO coll."), ("Halmb Project", "Project Halmbi"), ("침진을 공방", "공방 침진을"), ("Augustin Ralgamark", "Augustin Ralgamrak")])
def test_spellings_of_one_name(a, b):
    assert any(confirmed(x, y) for x in forms_of(a) for y in forms_of(b))


@pytest.mark.parametrize("a,b", [("김다영", "김도석"), ("Edward Remlimeer", "Edward Gilfidane"), ("박후근", "Ronggeun Hwang"), ("Kim Lab", "Lee Lab"), ("Gilmii Workshop", "Gilmif Studio"), ("Alexander Velnegren", "Alexander Zalnegren"), ("Margaret Delfimark", "Gabriela Delfimark"), ("서성시", "서선비"), ("DJ Sorgotex", "Borgotox")])
def test_other_names(a, b):
    assert not any(confirmed(x, y) for x in forms_of(a) for y in forms_of(b))


def test_a_given_name_alone_never_stands_by_itself():
    assert row_forms("김다영", None, ["다영"]) == row_forms("김다영", None, [])
    assert row_forms(None, None, None) == [] and edits("abcd", "abdc", 2) == 1


def test_linked_through_a_third_row(spark):
    df = artists(spark, [("1", "g1", "김유환", None, None, None), ("2", None, None, "Yuhwan Kim", "DJ Zalokio", None), ("3", "g3", None, "DJ Zalokio", None, None), ("4", "g4", "김유환", None, None, ("1999", "R", "F"))])
    assert rows(variant_pairs(df)) == [("1", "2"), ("1", "3"), ("2", "3")]


def test_two_aliases_alone_do_not_link(spark):
    df = artists(spark, [("1", None, "김유환", None, "Zalokio", None), ("2", None, "박하늘", None, "Zalokio|Studio Perrali", None), ("3", None, "정람호", "Studio Perrali", None, None)])
    assert rows(variant_pairs(df)) == [("2", "3")]


def test_a_shared_published_id_links_but_is_no_pair(spark):
    df = artists(spark, [("1", "g", "김유환", None, None, None), ("2", "g", None, "Corlifio", None, None), ("3", "h", None, "Corlifio", None, None)])
    assert rows(variant_pairs(df)) == [("1", "3"), ("2", "3")]


def test_initials_join_only_what_they_fit(spark):
    df = artists(spark, [("1", None, None, "Oh D", None, None), ("2", None, "오들원", None, None, None), ("3", None, "H. Park", "H. Park", None, None), ("4", None, "박후근", None, None, None), ("5", None, "박하늘", None, None, None), ("6", None, None, "Yoon D.A.", None, None), ("7", None, None, "D. Yun", None, None), ("8", None, None, "Kim E.", None, None), ("9", None, "김은근", None, None, None)])
    assert rows(variant_pairs(df)) == [("1", "2"), ("6", "7"), ("8", "9")]


def test_stand_ins_blank_and_null_names_link_nothing(spark):
    df = artists(spark, [("1", None, None, "Unknown ", "", None), ("2", None, "미상", "N/A", None, None), ("3", " ", " ", "unknown", "-", None), ("4", " ", None, None, None, (None, None, None)), ("5", None, "x" * 20000, None, None, None)])
    assert rows(variant_pairs(df)) == [] and same_entities(df.limit(0)).count() == 0


def test_null_attributes_agree_with_null(spark):
    df = artists(spark, [("1", None, "홍길순", None, None, (None, None, None)), ("2", None, "홍길순", None, None, (None, None, None))])
    assert rows(variant_pairs(df)) == [("1", "2")]


def test_average_linkage():
    links = {(0, 1): UNIT, (1, 2): UNIT // 10, (2, 3): UNIT * 9 // 10}
    assert clusters(4, links) == [0, 0, 2, 2] and clusters(0, {}) == []


def brute_clusters(n, links, least):
    """One best pair at a time."""
    groups = {i: [i] for i in range(n)}
    while True:
        best = min(((-sum(links.get((min(a, b), max(a, b)), 0) for a in x for b in y) / (len(x) * len(y)), i, j) for i, x in groups.items() for j, y in groups.items() if i < j), default=(0, 0, 0))
        if -best[0] < least * UNIT or not best[0]:
            return [next(i for i, x in groups.items() if k in x) for k in range(n)]
        groups[best[1]] += groups.pop(best[2])


def test_rounds_of_mutual_neighbours_give_the_tree_of_single_joins():
    r = random.Random(4)
    for n in (2, 5, 12, 25):
        for _ in range(30):
            links = {(i, j): r.randrange(1, UNIT) for i in range(n) for j in range(i + 1, n) if r.random() < 0.3}
            assert clusters(n, links, 0.15) == brute_clusters(n, links, 0.15)


def test_a_component_of_thousands_of_nodes():
    """A long chain of close neighbours: all pairs join, then nothing is near enough on average."""
    n = 6000
    got = clusters(n, {(i, i + 1): UNIT // 2 + (i % 2 == 0) for i in range(n - 1)}, 0.2)
    assert got == [i - i % 2 for i in range(n)]


def test_blocks_too_large_for_a_task_give_the_same_entities(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/artists.parquet")
    want = rows(same_entities(df))
    assert len(want) > 100 and rows(same_entities(df, task_rows=0)) == want
    # one block: a third and more of all rows under one key
    one = df.drop("region", "field", "active_since").selectExpr("*", "'x' AS region", "'y' AS field", "'2000' AS active_since")
    assert rows(same_entities(one, task_rows=0)) == rows(same_entities(one))


def test_every_close_pair_of_forms_is_found(spark, monkeypatch):
    """The join, cut into many cells, against all pairs."""
    monkeypatch.setattr(names, "CELL", 3)
    df = spark.read.parquet("/root/testdata/sf0.01/artists.parquet")
    made = [row_forms(r.name_ko, r.name_en, None) for r in df.collect()]
    forms = sorted({f for fs in made for f in fs if f[0] not in "AI"})
    table = spark.createDataFrame([("b", f) for f in forms], "block string, form string")
    got = {(r.a, r.b): r.sim for r in names._links(table, names.COSINE).collect()}
    space = names.Space(names._weights(table)[0])
    some = forms[::20]
    want = {(min(a, b), max(a, b)): round(space.cosine(a, b) * UNIT) for a in some for b in forms if a != b and space.cosine(a, b) >= names.COSINE and confirmed(a, b)}
    assert want and {k: got.get(k) for k in want} == want
