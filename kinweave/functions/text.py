"""Text keys, tokens and name shapes as column expressions (no Python in the row path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters read as a space, and the full-width block.
INVISIBLE = r"[\x00-\x1f\x7f\x{200b}-\x{200d}\x{feff}\x{a0}]"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: The parts of Hangul syllables in the Revised Romanization.
ONSETS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
NUCLEI = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
CODAS = ("", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")


#: ASCII and whole Hangul syllables are composed already and fold to their lower case.
UNCOMMON = r"[^\x00-\x7F\x{AC00}-\x{D7A3}]"
# a reflected call is no place for nulls: Spark may evaluate it before the condition that guards it


def nfc(c: Column) -> Column:
    """Composed form (NFC), by the ICU library that ships with Spark; what is composed already passes untouched."""
    return F.when(c.rlike(UNCOMMON), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))).otherwise(c)


def casefold(c: Column) -> Column:
    """Full Unicode case folding, as in straße and STRASSE."""
    return F.when(c.rlike(UNCOMMON), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.coalesce(c, F.lit("")), F.lit(True))).otherwise(F.lower(c))


def norm_text(c: Column) -> Column:
    """Composed form, invisible characters to spaces, runs of space to one, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(nfc(c), INVISIBLE, " "), r"[\s\p{Z}]+", " "), "^ +| +$", "")


def match_key(c: Column) -> Column:
    """Letters and digits of the composed text only, without regard to case."""
    # one test decides for both steps; the signs that composing leaves go in any case
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False)), F.lit(True))
    return F.regexp_replace(F.when(c.rlike(UNCOMMON), fold).otherwise(F.lower(c)), r"[^\p{L}\p{N}]+", "")


def script_shares(c: Column) -> tuple[Column, Column, Column]:
    """Counts of Hangul and Latin letters, and of both together."""
    ko, en = F.regexp_count(c, F.lit("[가-힣]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return ko, en, ko + en


def lang_of(c: Column, share: float = 0.2) -> Column:
    """ko, en, mixed or empty, by the share each script has of the letters."""
    ko, en, both = script_shares(c)
    has_ko, has_en = ko >= both * share, en >= both * share
    return F.when(both == 0, "").when(has_ko & has_en, "mixed").when(has_ko, "ko").otherwise("en")


def mostly_hangul(c: Column) -> Column:
    ko, _, both = script_shares(c)
    return ko * 2 > both


def script_of(c: Column) -> Column:
    return F.when(c.rlike("[가-힣]"), "hangul").when(c.rlike("[A-Za-z]"), "latin").otherwise("")


def words_of(c: Column) -> Column:
    """Distinct words, a Hangul run as one word, Latin in lower case."""
    return F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit("[가-힣]+"), F.lit(0)), F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))))


def strip_titles(c: Column) -> Column:
    """The text without bracketed work titles, unless nothing else is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"《[^》]*》|<[^>]*>|“[^”]*”", " "), r"\s+", " "))
    return F.when(bare == "", c).otherwise(bare)


def fold_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def place_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def hangul_compact(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit("[가-힣]+"), F.lit(0)), "")


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))


def title_base(c: Column) -> Column:
    """Match key without its trailing digits."""
    return F.regexp_replace(match_key(c), r"[0-9]+$", "")


def spaced_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


#: Letter groups that romanisations confuse, replaced in order.
CONFUSED = (
    ("eo", "o"), ("eu", "u"), ("oo", "u"), ("ae", "e"), ("ee", "i"), ("wo", "o"), ("yu", "u"),
    ("k", "g"), ("t", "d"), ("p", "b"), ("ch", "j"), ("r", "l"), ("c", "s"), ("x", "gs"),
)


def skeleton(c: Column) -> Column:
    """Letters and digits folded so that romanisations of one sound agree; runs of one letter once."""
    folded = reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), CONFUSED, F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    return F.regexp_replace(folded, r"(.)\1+", "$1")


def romanise(c: Column) -> Column:
    """Hangul syllables by arithmetic on their code points; other characters stay."""

    def letter(ch: Column) -> Column:
        k = F.ascii(ch) - 44032
        lead, vowel, tail = (F.array(*map(F.lit, xs)) for xs in (ONSETS, NUCLEI, CODAS))
        at = lambda xs, i: F.get(xs, i.cast("int"))
        return F.when((k >= 0) & (k < 11172), F.concat(at(lead, F.floor(k / 588)), at(vowel, F.floor((k % 588) / 28)), at(tail, k % 28))).otherwise(ch)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), letter), "")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` occur in ``long`` in order (letters and digits only)."""
    return F.rlike(long, F.array_join(F.regexp_extract_all(short, F.lit("[A-Za-z0-9]"), F.lit(0)), ".*"))


def initials(c: Column, skip: tuple[str, ...] = ("of", "the", "and", "for", "de", "la", "in", "at")) -> Column:
    words = F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*skip))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def split_pipe(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def join_pipe(c: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))), "|")


def note_value(c: Column, key: str) -> Column:
    """Value of ``key=`` in a ``;``-separated note, or empty."""
    return F.regexp_extract(c, rf"(?:^|;)\s*{key}=([^;]*?)\s*(?:;|$)", 1)


def title_bag(c: Column) -> Column:
    """Distinct runs of two or more letters, without regard to case; digits are left out."""
    return F.array_distinct(F.regexp_extract_all(casefold(norm_text(c)), F.lit(r"\p{L}{2,}"), F.lit(0)))


def titles_agree(a: Column, b: Column, least: float = 0.5) -> Column:
    """Jaccard similarity of the word sets of at least ``least``; titles of different scripts, or of none, cannot be compared and agree."""
    x, y = title_bag(a), title_bag(b)
    both = (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= F.size(F.array_union(x, y)) * least)
    return F.when((script_of(a) == "") | (script_of(a) != script_of(b)), True).otherwise(both)


def pair_key(a: Column, b: Column) -> Column:
    """Sixteen hex digits for an unordered pair of contents."""
    return F.substring(F.sha2(F.concat_ws("\u001e", F.array_sort(F.array(a, b))), 256), 1, 16)


def uuid5(name: Column, namespace: str) -> Column:
    """Version 5 UUID of ``name`` (RFC 9562) in a namespace given as UUID text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def tokenize(c: Column) -> Column:
    """Search tokens: runs of two or more letters or digits, and the pairs inside Hangul runs."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}|[가-힣]{2,}"), F.lit(0))
    hangul = F.regexp_extract_all(low, F.lit("[가-힣]{3,}"), F.lit(0))
    pairs = F.flatten(F.transform(hangul, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.array_distinct(F.concat(runs, pairs))
