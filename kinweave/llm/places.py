"""Mapping free-entered places to a canonical list.

The reference entries and their alias spellings form one trie. A typed place
walks it with a Levenshtein automaton (one row of edit counts per trie node,
neighbouring letters may be swapped), and all entries within the distance its
length allows come back; the closest decides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.split import VENUE_MAY_SPLIT, venue_values
from ..shipping import ship
from ..storage import Scratch
from .lookalikes import Plain, look_alikes
from .names import edits

#: Reference entries one task holds. Of a longer list each part of the rows gets the entries that can be near what it asks for.
MAX_ENTRIES = 500_000
#: Words for kinds of venue (longer ones first where one holds another), words put before them, and endings of administrative units.
VENUE_TYPES = (
    "museum of art", "museum of modern art", "museum of contemporary art", "culture foundation", "cultural foundation", "culture center", "cultural center", "art center", "arts center", "art centre", "arts centre", "concert hall", "opera house", "media lab",
    "hall", "gallery", "galerie", "galleria", "space", "theatre", "theater", "cinema", "festival", "biennale", "triennale", "kunstraum", "kunsthalle", "kunstverein", "kunsthaus", "room", "museum", "center", "centre", "foundation", "studio", "library", "archive", "academy",
    "institute", "university", "college", "school", "factory", "laboratory", "platform", "pavilion", "auditorium", "opera", "club", "hotel", "atelier", "residency", "plaza",
    "아트센터", "예술센터", "문화센터", "문화재단", "예술회관", "문화회관", "문화원", "미디어랩", "스페이스", "갤러리", "화랑", "미술관", "박물관", "전시관", "전시장", "공연장", "아트홀", "소극장", "축제", "페스티벌", "비엔날레", "극장", "영화관", "도서관", "아카이브",
    "대학교", "연구소", "플랫폼", "팩토리", "레지던시", "스튜디오", "하우스", "센터", "재단", "홀", "룸",
)
VENUE_WORDS = ("contemporary", "modern", "national", "metropolitan", "municipal", "city", "new", "old", "국립", "도립", "군립", "구립", "시립", "현대", "새")
UNITS = ("city", "si", "gun", "시", "군")
#: Letters from which on an unlisted Latin word beside a kind of venue is a place, not a proper name.
LONG_WORD = 7

_LATIN_TYPES = "|".join(sorted((t for t in VENUE_TYPES if t.isascii()), key=len, reverse=True))
_HANGUL_TYPES = "|".join(sorted((t for t in VENUE_TYPES if not t.isascii()), key=len, reverse=True))
TYPE = re.compile(rf"\b(?:{_LATIN_TYPES})\b|(?:{_HANGUL_TYPES})(?:\s|\d|/|$)")
PART = re.compile(r"[,，()（）]|\s[-–—]\s|^[-–—]\s|\s[-–—]$")
UNIT_END = re.compile(r"(?:\s+(?:city|si|gun|시|군)|-(?:si|gun)|(?<=\S)(?:시|군))$")
SPACES = re.compile(r"\s+")


def allowed(n: int) -> int:
    """Edits allowed for a typed place of ``n`` letters: none for short ones, where other places are one edit away, two for long ones."""
    return 0 if n < 5 else 1 if n < 12 else 2


def letters(s: str) -> str:
    return "".join(ch for ch in s.lower() if ch.isalnum())


class Trie:
    """Entries as nested dicts; the key ``None`` holds the canonicals that end at a node."""

    def __init__(self, entries: list[tuple[str, str, str, int]]):
        self.root: dict = {}
        for name, canonical, country, population in entries:
            node = self.root
            for ch in letters(name):
                node = node.setdefault(ch, {})
            node.setdefault(None, set()).add((canonical, country or "", population or 0))

    def within(self, word: str, most: int) -> list[tuple[int, str, str, int]]:
        """(distance, canonical, country, population) of every entry within ``most`` edits.

        The automaton's state is (letters read, edits left); only trie nodes that
        some state reaches are visited.
        """
        best: dict[tuple[str, str, int], int] = {}
        n = len(word)
        stack = [(self.root, 0, most)]
        while stack:
            node, i, left = stack.pop()
            if not left:
                while i < n and node is not None:
                    node = node.get(word[i])
                    i += 1
                if node is None:
                    continue
            if i == n and None in node:
                for e in node[None]:
                    best[e] = min(best.get(e, most), most - left)
            if not left:
                continue
            here = word[i] if i < n else None
            if here is not None:
                stack.append((node, i + 1, left - 1))
                if here in node:
                    stack.append((node[here], i + 1, left))
                if i + 1 < n and word[i + 1] in node and here in node[word[i + 1]]:
                    stack.append((node[word[i + 1]][here], i + 2, left - 1))
            for ch, child in node.items():
                if ch is not None:
                    stack.append((child, i, left - 1))
                    if here is not None and ch != here:
                        stack.append((child, i + 1, left - 1))
        return [(d, *e) for e, d in best.items()]


class Places:
    """Finds the place a venue text names."""

    def __init__(self, entries: list[tuple[str, str, str, int]], shape: tuple[set[str], set[int]] | None = None, look: dict[str, str] | None = None):
        """``shape``: the Hangul syllables and lengths of the names of the whole reference, if ``entries`` are a part of it."""
        self.trie = Trie(entries)
        own = [name for name, *_ in entries]
        self.syllables, self.hangul_lengths = shape or ({ch for n in own for ch in n if "가" <= ch <= "힣"}, {len(n) for n in own if "가" <= n[:1] <= "힣"})
        self.plain = Plain(look)
        self.typed: dict[tuple[str, str], str | None] = {}
        self.venues: dict[str, str | None] = {}

    def listed(self, typed: str, country: str = "") -> str | None:
        """Canonical of the closest entry, with and without an administrative ending; ties by country, then population."""
        key = (typed, country)
        if key not in self.typed:
            best = None
            for form in dict.fromkeys((typed, UNIT_END.sub("", typed))):
                w = letters(form)
                near = (self.trie.within(w, 0) or self.trie.within(w, allowed(len(w)))) if w else []
                for d, canonical, c, pop in near:
                    best = min(x for x in (best, (d, c != country, -pop, canonical)) if x)
            self.typed[key] = best[3] if best else None
        return self.typed[key]

    def of(self, venue: str) -> str | None:
        """Canonical; the empty string for a place that is not listed; None where no place is named."""
        s = SPACES.sub(" ", self.plain(venue)).strip(" .,;:-–")
        country, parts = "", []
        for p in (x.strip(" .;:") for x in PART.split(s)):
            if re.fullmatch("[A-Za-z]{2}", p):
                country = p.upper()
            elif letters(p):
                parts.append(p.lower())
        places = [p for p in parts if not TYPE.search(p)]
        if len(parts) > 1 and places and len(places) < len(parts):
            found = [x for x in (self.listed(p, country) for p in places) if x]
            return found[0] if found else ""
        within = [x for x in (self._inside(p, country) for p in parts) if x is not None]
        return next((x for x in within if x), within[0] if within else None)

    def _inside(self, part: str, country: str) -> str | None:
        """A place beside a kind of venue without a sign between them."""
        if not TYPE.search(part):
            return self.listed(part, country)
        generic = False
        body = re.sub(r"^the\b", " ", part)
        body = re.sub(rf"\b(?:{_LATIN_TYPES})\b", " ", body)
        body = re.sub(rf"(?:{_HANGUL_TYPES})(?=\s|\d|/|$)", " ", body)
        words, unit = [], False
        for w in body.split():
            if w in VENUE_WORDS:
                generic = True
            elif w in UNITS:
                unit = True
            else:
                words.append(w)
        for w in words:
            got = self.listed(w, country)
            if got:
                return got
            for g in VENUE_WORDS:
                if not g.isascii() and w.endswith(g) and len(w) > len(g):
                    got = self.listed(w[: -len(g)], country)
                    if got:
                        return got
                    generic = True
        for k, w in enumerate(words):
            bare = letters(UNIT_END.sub("", w))
            if bare.isascii():
                if len(bare) >= LONG_WORD or (generic and bare.isalpha() and len(words) == 1):
                    return ""
            elif w != UNIT_END.sub("", w) and len(words) > 1 and k == 0 or unit and k == 0 or self._of_place_syllables(w):
                return ""
        return None

    def _of_place_syllables(self, w: str) -> bool:
        for form in (w, UNIT_END.sub("", w), *(w[: -len(g)] for g in VENUE_WORDS if w.endswith(g))):
            if len(form) in self.hangul_lengths and all(ch in self.syllables for ch in form):
                return True
        return False

    def asked(self, venue: str) -> set[str]:
        """Every string of letters the trie may be asked for."""
        found: set[str] = set()
        asking = Asking(self, found)
        asking.of(venue)
        return found

    def find(self, venue: str) -> str | None:
        if venue not in self.venues:
            if len(self.venues) > 200_000:
                self.venues.clear()
                self.typed.clear()
            self.venues[venue] = self.of(venue)
        return self.venues[venue]


class Asking(Places):
    """Walks through the rules as if nothing were listed, and notes what is asked for."""

    def __init__(self, places: Places, found: set[str]):
        self.syllables, self.hangul_lengths, self.plain, self.found = places.syllables, places.hangul_lengths, places.plain, found

    def listed(self, typed: str, country: str = "") -> str | None:
        self.found.update(filter(None, map(letters, (typed, UNIT_END.sub("", typed)))))
        return None


def neighbourhood(word: str, edits: int = 1) -> set[str]:
    """The word with up to so many letters less: two words within as many edits (or swaps) have one in common."""
    found = last = {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


_held: dict[str, Places] = {}


def _places(key: str, entries: list[tuple[str, str, str, int]], shape: tuple[set[str], set[int]], look: dict[str, str]) -> Places:
    """The matcher of one run, kept by the worker between its tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = Places(entries, shape, look)
    return _held[key]


def venue_places(rows: DataFrame, row_id: str, venue: str, reference: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """(row_id, canonical) of each single-valued venue that names a place.

    ``canonical`` is empty for a place the reference (name, canonical, country,
    population) lacks. Null, blank and packed cells, and venues without a place,
    give no row. An empty reference leaves every place unmatched. A reference of up
    to ``most`` entries is held in every task and nothing is shuffled; a longer one
    is cut, for ever smaller parts of the rows, to the entries within an edit of
    what they ask for, with the same result.
    """
    ship(rows.sparkSession)
    entries = reference.filter(F.col("name").isNotNull() & F.col("canonical").isNotNull()).select("name", "canonical", "country", F.col("population").cast("long").alias("population")).distinct()
    n = entries.count()
    hangul = entries.filter(F.col("name").rlike("^[가-힣]")).select(F.length("name").alias("n")).distinct()
    # at most all syllables there are, and the lengths of names
    syllables = entries.select(F.explode(F.regexp_extract_all("name", F.lit("[가-힣]"), F.lit(0))).alias("c")).distinct()
    shape = {r[0] for r in syllables.collect()}, {r[0] for r in hangul.collect()}
    look = look_alikes(rows.sparkSession)
    cell = F.col("venue")
    src = rows.select(F.col(row_id).alias("row_id"), F.col(venue).alias("venue")).filter(cell.isNotNull())
    values = venue_values(cell)
    one = F.when(~cell.rlike(VENUE_MAY_SPLIT), cell).otherwise(F.when(F.size(values) == 1, F.element_at(values, 1)))
    src = src.select("row_id", one.alias("venue")).filter(cell.isNotNull())
    return _placed(src, entries, shape, look) if n <= most else _in_parts(src, entries, shape, look, most, 1, 0)


def _in_parts(src: DataFrame, entries: DataFrame, shape: tuple[set[str], set[int]], look: dict[str, str], most: int, parts: int, part: int) -> DataFrame:
    """The rows of one part of the venues, against the entries that can be near them; halved while those are too many."""
    own = src.filter(F.pmod(F.xxhash64("venue"), F.lit(parts)) == part)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places("asking", [], shape, look)
        for batch in batches:
            asked = sorted({a for v in batch.column(0).to_pylist() for a in places.asked(v)})
            near = [sorted(neighbourhood(a, allowed(len(a)))) for a in asked]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(near, pa.list_(pa.string()))], names=["a", "ws"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # what is typed may be longer than the entry, and so allow more
            near = [sorted(neighbourhood(w, allowed(len(w) + 2))) for w in map(letters, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.list_(pa.string()))], names=["name", "ws"])

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [edits(a, letters(n), allowed(len(a))) <= allowed(len(a)) for a, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["name"])

    asked = own.select("venue").distinct().mapInArrow(ask, "a string, ws array<string>").select("a", F.explode("ws").alias("w")).distinct()
    spelt = entries.select("name").distinct().mapInArrow(spell, "name string, ws array<string>").select("name", F.explode("ws").alias("w"))
    names = asked.join(spelt, "w").select("a", "name").distinct().mapInArrow(sure, "name string").distinct()
    near, n = Scratch(src.sparkSession, "places").counted(entries.join(names, "name", "left_semi"), "near")
    # what is near a single venue is what one walk finds
    if n <= most or own.select("venue").distinct().limit(2).count() < 2:
        return _placed(own, near, shape, look)
    halves = [_in_parts(src, entries, shape, look, most, 2 * parts, p) for p in (part, part + parts)]
    return halves[0].unionByName(halves[1])


def _placed(src: DataFrame, entries: DataFrame, shape: tuple[set[str], set[int]], look: dict[str, str]) -> DataFrame:
    shared, run_key = src.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.select("name", "canonical", "country", "population").collect()]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(run_key, shared.value, shape, look)
        for batch in batches:
            ids, got = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = places.find(v)
                if c is not None:
                    ids.append(i), got.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(got, pa.string())], names=["row_id", "canonical"])

    return src.mapInArrow(run, f"row_id {src.schema['row_id'].dataType.simpleString()}, canonical string")
