import pytest

from kinweave.llm.places import Places, Trie, allowed, neighbourhood, venue_places
from kinweave.llm.names import edits

from ..conftest import rows

ENTRIES = [("Harberepolis", "Harberepolis", "BR", 10), ("Bordodestok", "Bordodestok", "NL", 5), ("Gilrolepolis", "Bordodestok", "NL", 5), ("두별바", "Dubyeolba", "KR", 7), ("Dubyeolba", "Dubyeolba", "KR", 7), ("내빛시", "Naebitsi", "KR", 3), ("Samename", "Samenama", "DE", 1), ("Samenamy", "Samenamb", "FR", 9)]


@pytest.mark.parametrize("venue,want", [
    ("The Hall, Harberepolis", "Harberepolis"), ("The Hall (HARBEREPOLIS City), BR", "Harberepolis"), ("Hall - Harberpolis", "Harberepolis"), ("harebrepolis, the hall", "Harberepolis"),
    ("Har-berepolis Contemporary Hall", "Harberepolis"), ("Gallery Gilrolepolis", "Bordodestok"), ("룸 24/7(두별바시)", "Dubyeolba"), ("두별바 현대미술관", "Dubyeolba"), ("두별바미술관", "Dubyeolba"), ("내빛시 홀", "Naebitsi"),
    ("카모 홀, 내빛시시", "Naebitsi"), ("Room 24/7, Duby-eolba-gun", "Dubyeolba"), ("Hall X, Narbimenia", ""), ("홀 X (두별마)", ""), ("Hаll, Ｈａｒｂｅｒｅｐｏｌｉｓ", "Harberepolis"), ("New Narbimenia Hall", ""),
    ("Gallery Fusa", None), ("The Misa Hall", None), ("K-Ann & Sons Hall", None), ("Space 7/8", None), ("라모홀", None), ("소루보 축제", None), ("", None), (" - ", None), ("Hall, KR", None),
    ("Hall, Samenamz, FR", "Samenamb"), ("Hall, Samenamz, DE", "Samenama"), ("Hall, Samenamz", "Samenamb"),
])
def test_places_of_venues(venue, want):
    assert Places(ENTRIES).find(venue) == want


def test_walk_against_brute_force():
    names = ["abcde", "abxde", "abcdf", "bacde", "abcd", "zzzzz", "가나다"]
    t = Trie([(n, n, "", 0) for n in names])
    for w in ("abcde", "abced", "abde", "abcdee", "zzz", "가나", "", "xbcde"):
        for most in (0, 1, 2):
            assert sorted({(d, n) for d, n, *_ in t.within(w, most)}) == sorted((edits(w, n, most), n) for n in names if edits(w, n, most) <= most)


def test_rows(spark):
    ref = spark.createDataFrame(ENTRIES + [(None, "x", "KR", 1), ENTRIES[0]], "name string, canonical string, country string, population bigint")
    df = spark.createDataFrame([("1", "Hall, Harberepolis", "a"), ("2", "Hall, Harberepolis | Room", "b"), ("3", None, "c"), ("4", "Hall, Harberepolis;", "d"), ("5", "x" * 30000, "e"), (None, "Hall, Nowhereville", "f")], "i string, venue string, canonical string")
    got = venue_places(df, "i", "venue", ref)
    assert rows(got.filter("row_id IN ('1', '4')")) == [("1", "Harberepolis"), ("4", "Harberepolis")]
    assert got.filter("row_id = '2' OR row_id = '3'").count() == 0 and rows(got.filter("row_id IS NULL")) == [(None, "")]
    assert rows(venue_places(df.limit(1), "i", "venue", ref.limit(0))) == [("1", "")]
    assert venue_places(df.limit(0), "i", "venue", ref).count() == 0


def test_words_within_the_allowed_edits_have_a_shorter_one_in_common():
    for a, b in (("abcdef", "abdcef"), ("abcdefghijklm", "abxcdefgijklm"), ("abcdefghijklm", "bacdefghijkml"), ("abcdef", "abcef")):
        d = edits(a, b, 2)
        assert neighbourhood(a, d) & neighbourhood(b, d)
    assert [allowed(n) for n in (4, 5, 11, 12)] == [0, 1, 1, 2]


def test_a_reference_too_long_for_a_task(spark):
    ref = spark.createDataFrame(ENTRIES + [(f"Place{i:05d}", f"P{i}", "KR", i) for i in range(400)], "name string, canonical string, country string, population bigint")
    venues = ["The Hall, Harberpolis", "Gallery Gilrolepolis", "두별바시립미술관", "홀 X (두별마)", "New Narbimenia Hall", "Hall, Place00017", "Hall, Samenamz, DE", "K-Ann & Sons Hall", "Hall (Plaec00300)"]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(venues)], "i string, venue string")
    want = rows(venue_places(df, "i", "venue", ref))
    assert ("5", "P17") in want and rows(venue_places(df, "i", "venue", ref, most=4)) == want
