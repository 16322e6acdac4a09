import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions.venue_names import Venues, skeleton
from kinweave.operators import venue_merges as vm

from .conftest import rows

PLACES = {"서울": "seoul", "seoul": "seoul", "청주": "cheongju", "과천": "gwacheon", "덕수궁": "", "busan": "busan", "부산": "busan", "karlsruhe": "karlsruhe", "cheongju": "cheongju", "노원": "nowon", "nowon": "nowon", "berlin": "berlin"}
V = Venues(PLACES)


@pytest.mark.parametrize("text,key", [("Space 1957", "space 1957"), ("Studio Etc", "studio etc"), ("Example Gallery 2019", "example gallery"), ("제12회 예시비엔날레", "예시비엔날레"), ("서울시립미술관 《빛》", "서울시립미술관"), ("예시 미술관 외", "예시미술관"), ("The “Blue” Room", "blue room"), ("2019 The Space X", "space x"), ("", "")])
def test_keys(text, key):
    assert V.key(text) == key and V.key(key) == key


def test_generic_names_and_sites():
    assert V.generic("시립미술관 외") and V.generic("museum of art") and not V.generic("gallery 1898") and not V.generic("예시미술관") and not V.generic("12")
    assert [V.parent(f"국립현대미술관{p}") for p in ("전시실", "창고동", "별관", "청주관", "서울관", "덕수궁관")] == ["국립현대미술관"] * 3 + [""] * 3
    assert V.parent("노원구청") == "" and V.parent("white cube annex") == "white cube" and V.parent("seoul city hall") == "" and V.parent("white cube lobby") == "white cube"
    assert V.branch("국립현대미술관청주관") == ("국립현대미술관", "cheongju") and V.branch("예시별관") == ("", "") and V.office_of("nowon district office") == "nowon"
    assert skeleton("acc") == skeleton("aas") and V.signature("예시미술관") != V.signature("예시시립미술관")
    assert V.bags("현대나비") == [("contemporary", "~nabi"), ("modern", "~nabi")]


def entities(spark, venues, rules=("V7", "V8", "V9")):
    """Spelling -> entity; a venue may be written with its city after a bar."""
    data = [(i, *(v.split("|") + [""])[:2]) for i, v in enumerate(venues)]
    df = spark.createDataFrame(data, "key int, name string, town string")
    places = spark.createDataFrame(list(PLACES.items()), "k string, c string")
    ents, edges = vm.venue_entities(df, "name", "town", places, "k", "c", rules)
    return {(r["name"], r["town"]): r["entity"] for r in ents.collect()}, sorted(rows(edges))


def test_names_of_one_venue_and_of_others(spark):
    names = ["서울시립미술관 《빛》", "서울시립미술관 외", "Seoul Museum of Art", "국립현대미술관", "국립현대미술관 서울관", "국립현대미술관 전시실", "ZKM Karlsruhe", "ZKM|karlsruhe", "Art Center Nabi", "Art Centre Nabi", "아트센터나비", "ACC", "AAS", "BUG", "Book", "MMCA", "MCA",
             "New York University", "City University of New York", "Museum of Modern Art", "Modern Art Museum", "현대나비", "Contemporary Nabi", "Modern Nabi", "노원", "노원구청", "Nowon District Office"]
    random.Random(1).shuffle(names)
    got, edges = entities(spark, names)
    e = {n: v for (n, _), v in got.items()}
    assert e["서울시립미술관 《빛》"] == e["서울시립미술관 외"] == e["Seoul Museum of Art"]
    assert e["국립현대미술관 전시실"] == e["국립현대미술관"] != e["국립현대미술관 서울관"]
    assert e["ZKM Karlsruhe"] == e["ZKM"] and e["Art Center Nabi"] == e["Art Centre Nabi"] == e["아트센터나비"]
    assert e["현대나비"] == e["Contemporary Nabi"] != e["Modern Nabi"] and e["노원"] != e["노원구청"]
    for a, b in (("ACC", "AAS"), ("BUG", "Book"), ("MMCA", "MCA"), ("New York University", "City University of New York"), ("Museum of Modern Art", "Modern Art Museum"), ("국립현대미술관", "서울시립미술관 외")):
        assert e[a] != e[b], (a, b)
    assert {r for r, *_ in edges} == {"V7e", "V8", "V9"}
    assert entities(spark, sorted(names)) == (got, edges)


def test_generic_names_by_city_and_acronyms_of_two_cities(spark):
    got, _ = entities(spark, ["Museum of Art|busan", "Museum of Art|seoul", "Example Museum of Art|busan", "Example Museum of Art", "XYZ|seoul", "XYZ|busan", "XYZ Seoul", "XYZ", "예시미술관", "예시시립미술관", "Yesi Museum of Art"])
    assert got["Museum of Art", "busan"] != got["Museum of Art", "seoul"] and got["Example Museum of Art", "busan"] == got["Example Museum of Art", ""]
    assert got["XYZ Seoul", ""] != got["XYZ", ""] and len({got[n, ""] for n in ("예시미술관", "예시시립미술관", "Yesi Museum of Art")}) == 3


def test_rules_may_be_left_out_and_empty_tables_give_nothing(spark):
    got, edges = entities(spark, ["예시시립미술관", "Yesi Museum of Art", "Yesi Center", "Yesi Centre"], ("V7",))
    assert got["예시시립미술관", ""] != got["Yesi Museum of Art", ""] and [e[0] for e in edges] == ["V7e"]
    got, edges = entities(spark, ["예시시립미술관", "Yesi Museum of Art"])
    assert len(set(got.values())) == 1 and [e[0] for e in edges] == ["V9"]
    df = spark.createDataFrame([], "name string, town string")
    ents, edges = vm.venue_entities(df, "name", "town", spark.createDataFrame([("a", "b")], "k string, c string"), "k", "c")
    assert ents.count() == 0 and edges.count() == 0


def test_fragments(spark):
    df = spark.createDataFrame([("국립현대미술관 MMCA (서울 [종로]) - Hall, x",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(vm.fragments(F.col("c"))).collect()] == [["국립현대미술관", "MMCA", "서울", "종로", "Hall", "x"], [], None]
