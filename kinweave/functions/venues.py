"""Venue cells as fragments, kinds and keys, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .split import trimmed, venue_values
from .text import initials, words_of

#: Words that make a fragment a kind of body; the first kind found counts.
KINDS = (
    ("online", r"(?i)\bonline\b|\bzoom\b|온라인"),
    ("funder", r"(?i)\bfoundation\b|\bcouncil\b|재단|위원회"),
    ("museum", r"(?i)\bmuseum\b|\bkunst(?:raum|halle)\b|미술관|박물관|전시관"),
    ("gallery", r"(?i)\bgallery\b|\bspace\b|\broom\b|갤러리|스페이스|룸"),
    ("stage", r"(?i)\btheat(?:re|er)\b|\bhall\b|\bfestival\b|극장|홀|축제"),
    ("lab", r"(?i)\blab\b|\bcenter\b|\bcentre\b|랩|센터"),
)
#: Words any body may carry, which identify none by themselves.
GENERIC = ("the", "art", "arts", "museum", "of", "hall", "gallery", "space", "theatre", "festival", "kunstraum", "culture", "foundation", "center", "media", "lab", "contemporary", "city", "new", "room", "갤러리", "스페이스", "미술관", "축제", "극장", "홀", "전시관", "문화재단", "미디어랩", "아트센터", "룸", "시립", "현대", "새")


def fragments(c: Column) -> Column:
    """Parts of every value of a venue cell: outside and inside of brackets, and between commas and spaced hyphens."""
    parts = F.flatten(F.transform(venue_values(c), lambda v: F.split(v, r"[,，()（）]|\s[-–—]\s", -1)))
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def bracketed(c: Column) -> Column:
    """(outer, inner) of each ``outer (inner)`` in a cell: candidates for two names of one body or a body and its place."""
    pairs = F.regexp_extract_all(c, F.lit(r"[^,()（）|;\n]+[(（][^()（）]+[)）]"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(trimmed(F.regexp_extract(p, r"^([^(（]+)", 1)).alias("outer"), trimmed(F.regexp_extract(p, r"[(（]([^)）]+)[)）]", 1)).alias("inner")))


def kind_of(c: Column) -> Column:
    out = F.lit("other")
    for name, pat in reversed(KINDS):
        out = F.when(c.rlike(pat), F.lit(name)).otherwise(out)
    return F.when(c.isNull() | (F.trim(c) == ""), "").otherwise(out)


def is_generic(c: Column) -> Column:
    """All words of the name are generic, so the name alone identifies nobody."""
    w = words_of(c)
    return (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*GENERIC))


def word_bag(c: Column) -> Column:
    """Words in sorted order without articles: one key for a name in another order."""
    return F.array_join(F.array_sort(F.filter(words_of(c), lambda w: ~w.isin("the", "of", "and"))), " ")


def entity_key(name: Column, place: Column) -> Column:
    """The bag of a name, with its place where the name is generic."""
    return F.when(is_generic(name), F.concat_ws("@", word_bag(name), F.nullif(F.lower(F.coalesce(place, F.lit(""))), F.lit("")))).otherwise(word_bag(name))


def acronym_fits(short: Column, long: Column) -> Column:
    """An upper-case short name equal to the initials of the long one."""
    letters = F.regexp_replace(short, "[^A-Z0-9]", "")
    return (F.length(letters) >= 3) & (letters == initials(long))
