"""Predicates over pairs of person records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import hangul_compact, latin_tokens


def identity_keys(note: Column) -> Column:
    """Map namespace → key of the ``identity=namespace:key`` marks of a note; the first mark of a namespace counts."""
    marks = F.filter(F.transform(F.split(F.coalesce(note, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"^identity=[^:]+:.+"))
    pairs = F.transform(marks, lambda x: F.struct(F.regexp_extract(x, r"^identity=([^:]+):", 1).alias("k"), F.regexp_extract(x, r"^identity=[^:]+:(.+)$", 1).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def pinned_apart(a: Column, b: Column) -> Column:
    """Two notes name different identities in one namespace."""
    x, y = identity_keys(a), identity_keys(b)
    return F.exists(F.map_keys(x), lambda k: F.coalesce(F.element_at(x, k) != F.element_at(y, k), F.lit(False)))


def hangul_contradicts(a: Column, b: Column) -> Column:
    """Both names have Hangul and it differs."""
    x, y = hangul_compact(a), hangul_compact(b)
    return (x != "") & (y != "") & (x != y)


def same_tokens(a: Column, b: Column, least: int = 2) -> Column:
    """The Latin words of two names are the same set of at least ``least``."""
    x, y = F.array_sort(F.array_distinct(latin_tokens(a))), F.array_sort(F.array_distinct(latin_tokens(b)))
    return (F.size(x) >= least) & (x == y)


def names_meet(a_ko: Column, a_en: Column, b_ko: Column, b_en: Column) -> Column:
    """Equal Hangul or the same Latin words, and no contradiction in Hangul."""
    blank = F.lit("")
    ak, bk, ae, be = (F.coalesce(c, blank) for c in (a_ko, b_ko, a_en, b_en))
    equal = (hangul_compact(ak) != "") & (hangul_compact(ak) == hangul_compact(bk))
    return (equal | same_tokens(ae, be)) & ~hangul_contradicts(ak, bk)


def same_activity(year_a: Column, title_a: Column, year_b: Column, title_b: Column, hangul: int = 4, latin: int = 6) -> Column:
    """Same year and one title equal to or holding the other; a held title needs a least length by script."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    x, y = key(title_a), key(title_b)
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    enough = F.length(short) >= F.when(short.rlike("[가-힣]"), hangul).otherwise(latin)
    return (year_a == year_b) & (short != "") & ((x == y) | (enough & F.contains(long, short)))


def url_embeds_name(url: Column, tokens: Column) -> Column:
    """A name token of three or more letters stands in the letters and digits of the decoded URL."""
    flat = F.lower(F.regexp_replace(F.try_url_decode(url), r"[^\p{L}\p{N}]+", ""))
    return F.exists(tokens, lambda t: (F.length(t) >= 3) & F.contains(flat, F.lower(t)))
