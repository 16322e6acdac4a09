"""Keys, marks, labels and credits of archive rows, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import code_family, generation_of
from .split import trimmed
from .text import casefold, nfc, uuid5

BETWEEN = "\u001f"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
SPACES = r"[\s\p{Z}]+"
HANGUL = "[가-힣]"
#: What may follow a Hangul name inside its word: particles, the copula and a suffix for shows, longer ones first.
TRAILERS = (
    "에서의 에서는 에서도 으로의 으로는 에게서 에서 에게 에는 에도 에의 으로 로의 로는 과의 와의 까지 부터 이다 이며 이고 처럼 보다 한테 께서 "
    "은 는 이 가 을 를 의 에 께 와 과 로 도 만 며 들 전 展"
).split()


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# --- text of sources


def collapse(c: Column) -> Column:
    """Composed form without controls, runs of space to one, without regard to case."""
    return casefold(trimmed(F.regexp_replace(F.regexp_replace(nfc(c), CONTROLS, ""), SPACES, " ")))


def strip_punct(c: Column) -> Column:
    """As ``collapse``, with every sign that is no letter, digit or mark as a space."""
    return collapse(F.regexp_replace(nfc(c), r"[^\p{L}\p{N}\s\p{Z}]", " "))


def source_lines(c: Column) -> Column:
    """Without zero-width characters and blank lines, runs of space in a line to one."""
    lines = F.transform(F.split(F.regexp_replace(c, ZERO_WIDTH, ""), r"\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]"), lambda x: trimmed(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fingerprint(c: Column) -> Column:
    """SHA-256 of a text without white space, so re-wrapped lines are no change."""
    return F.sha2(F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), SPACES, ""), 256)


def bundle_fingerprint(documents: Column) -> Column:
    """``fingerprint`` of an array of (id, text) in the order of ids."""
    return fingerprint(F.array_join(F.transform(F.array_sort(documents), lambda x: x["text"]), "\n"))


def replay_key(documents: Column, tag: str) -> Column:
    """SHA-256 of a version tag and an ``id fingerprint`` line for each (id, text), in the order of ids."""
    lines = F.transform(F.array_sort(documents), lambda x: F.concat_ws(" ", x["id"], fingerprint(x["text"])))
    return F.sha2(F.array_join(F.concat(F.array(F.lit(tag)), lines), "\n"), 256)


def relative_years(c: Column, taken: Column) -> Column:
    """Years a page states as "N days ago", counted back from the day it was taken; none without a day."""
    days = F.regexp_extract_all(casefold(c), F.lit(r"(?<!\d)(\d{1,5})\s+days?\s+ago\b"), F.lit(1))
    return F.when(taken.isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.transform(days, lambda d: F.year(F.date_sub(taken, d.cast("int")))))))


def occurs(needle: Column, text: Column, loose_spaces: bool = False) -> Column:
    """The needle stands in the text as words of its own; a Hangul needle may carry one listed particle. An empty needle does not.

    ``loose_spaces``: between any two characters of the needle a space may stand or be missing.
    """
    n = trimmed(_text(needle))
    chars = F.regexp_extract_all(F.regexp_replace(n, SPACES, "" if loose_spaces else " "), F.lit("(?s)."), F.lit(0))
    literal = F.transform(chars, lambda ch: F.when(ch == " ", F.lit(r"[\s\p{Z}]+")).otherwise(F.concat(F.lit(r"\Q"), ch, F.lit(r"\E"))))
    body = F.array_join(literal, r"[\s\p{Z}]?" if loose_spaces else "")
    head = F.when(F.substring(n, 1, 1).rlike(r"^[\p{L}\p{N}]"), F.lit(r"(?<![\p{L}\p{N}\p{M}_])")).otherwise("")
    last = F.right(n, F.lit(1))
    tail = F.when(last.rlike(HANGUL), F.lit("(?:" + "|".join(TRAILERS) + r")?(?![\p{L}\p{N}\p{M}_])")).when(last.rlike(r"[\p{L}\p{N}]"), F.lit(r"(?![\p{L}\p{N}\p{M}_&&[^가-힣]])")).otherwise("")
    return F.when(n == "", False).otherwise(F.rlike(_text(text), F.concat(head, body, tail)))


# --- keys of rows


def title_identity(c: Column) -> Column:
    return F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}]+", "")


def activity_key(person: Column, source: Column, title: Column, year: Column, kind: Column, venue: Column, origin: Column | None = None) -> Column:
    """The identity of a row as one string; the origin counts only where it is given and not empty."""
    parts = F.concat_ws(BETWEEN, _text(person), _text(source), title_identity(title), _text(year), _text(kind), trimmed(_text(venue)))
    return parts if origin is None else F.when(_text(origin) != "", F.concat(parts, F.lit(BETWEEN), origin)).otherwise(parts)


def listed_key(row: dict[str, Column]) -> Column:
    """Key of a row read from a document: its source is what follows ``cv:`` in the origin."""
    origin = _text(row["origin"])
    return activity_key(row["ledger_id"], F.when(origin.startswith("cv:"), F.substring(origin, 4, 1 << 20)).otherwise(""), row["title"], row["year"], row["activity_type"], row["venue"])


def collected_key(row: dict[str, Column]) -> Column:
    """Key of a row a collector wrote: its source is the URL, and the edition counts."""
    kind = F.when(_text(row["activity_type"]) == "", "other").otherwise(row["activity_type"])
    return activity_key(row["ledger_id"], row["source_url"], row["title"], row["year"], kind, row["venue"], row["origin"])


def key_id(key: Column, ordinal: Column, namespace: str) -> Column:
    """Version 5 UUID of a key; later rows of one key carry their ordinal."""
    return uuid5(F.when(ordinal == 0, key).otherwise(F.concat(key, F.lit(BETWEEN), ordinal.cast("string"))), namespace)


def reading_key(row: dict[str, Column]) -> Column:
    """Sixteen hex digits for one reading of a document, whoever it belongs to."""
    parts = [F.regexp_replace(_text(row["origin"]), "^cv:", ""), trimmed(_text(row["year"])), _text(row["activity_type"]), collapse(_text(row["title"])), collapse(_text(row["venue"]))]
    return F.substring(F.sha2(F.concat_ws(BETWEEN, *parts), 256), 1, 16)


def pseudonym(c: Column, key: bytes) -> Column:
    """``ps`` and half of the HMAC-SHA-256 of a value: the same in every release that uses the key (RFC 2104)."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "utf-8")), 256))), 256)
    return F.concat(F.lit("ps"), F.substring(digest, 1, 32))


# --- marks of merges


def rule_of(evidence: Column) -> Column:
    """The rule an evidence text names first (E1 to E4, also after X1+), or null."""
    return F.nullif(F.regexp_extract(evidence, r"^((?:X1\+)?E[1-4])(?: |$)", 1), F.lit(""))


def stratum_of(rule: Column) -> Column:
    return F.when(trimmed(_text(rule)).rlike(r"^(?:X1\+)?E[1-4]$"), trimmed(rule)).otherwise("uncoded")


def merge_marks(note: Column) -> Column:
    """Array of (dropped, evidence, rule) from a note of ``merged ID``, ``merge_evidence=`` and ``rule=`` parts.

    Ids that stand before one evidence share it; a rule, or an id after an
    evidence, ends the group. Parts of other kinds are passed over.
    """
    parts = F.filter(F.transform(F.split(_text(note), ";"), trimmed), lambda p: p != "")
    blank, none = F.lit(""), F.array().cast("array<string>")
    found = F.array().cast("array<struct<dropped:string,evidence:string,rule:string>>")
    state = lambda done, ids, ev: F.struct(done.alias("done"), ids.alias("ids"), ev.alias("ev"))
    closed = lambda s, rule: F.concat(s["done"], F.transform(s["ids"], lambda i: F.struct(i.alias("dropped"), s["ev"].alias("evidence"), rule.alias("rule"))))

    def step(s: Column, p: Column) -> Column:
        merged, ev, rule = F.regexp_extract(p, r"^merged\s+(\S+)$", 1), F.regexp_extract(p, r"(?s)^merge_evidence=(.*)$", 1), F.regexp_extract(p, r"(?s)^rule=(.*)$", 1)
        some = F.size(s["ids"]) > 0
        return (
            F.when((merged != "") & (s["ev"] != ""), state(closed(s, blank), F.array(merged), blank))
            .when(merged != "", state(s["done"], F.concat(s["ids"], F.array(merged)), blank))
            .when(some & p.startswith("merge_evidence="), state(s["done"], s["ids"], trimmed(ev)))
            .when(some & p.startswith("rule="), state(closed(s, trimmed(rule)), none, blank))
            .otherwise(s)
        )

    return F.aggregate(parts, state(found, none, blank), step, lambda s: closed(s, blank))


# --- labels


def short_name(c: Column) -> Column:
    """Without brackets and what follows a spaced middle dot or dash, unless nothing is left."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(c, r"\s*[(（][^)）]*[)）]", ""), "(?s)(?: · | — ).*$", ""))
    return F.when(bare == "", c).otherwise(bare)


def generation_label(year: Column, width: int = 5) -> Column:
    """``2000–2004`` for the bin of a year, ``undated`` for none."""
    start = generation_of(year, width)
    return F.when(year.isNull(), "undated").otherwise(F.concat_ws("–", start.cast("string"), (start + width - 1).cast("string")))


def keywords(c: Column) -> Column:
    """Parts between commas outside brackets, in the order written, runs of space to one."""
    chars = F.regexp_extract_all(_text(c), F.lit("(?s)."), F.lit(0))
    state = lambda depth, out: F.struct(depth.alias("depth"), out.alias("out"))

    def step(s: Column, ch: Column) -> Column:
        depth = F.when(ch.isin(*"([{（［"), s["depth"] + 1).when(ch.isin(*")]}）］"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return state(depth, F.concat(s["out"], F.when(ch.isin(",", "，") & (depth == 0), F.lit("\u0000")).otherwise(ch)))

    marked = F.aggregate(chars, state(F.lit(0), F.lit("")), step, lambda s: s["out"])
    return F.filter(F.transform(F.split(marked, "\u0000"), lambda x: trimmed(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")


def needle_tags(text: Column, needles: list[tuple[str, str]], home: str = "", fallback: str = "") -> Column:
    """Tags of the needles a text holds, in the order of the list; the fallback where none fits but the text is home or abroad. None for an empty text."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(text.contains(n), F.lit(tag)) for n, tag in needles])))
    rest = F.array(F.lit(fallback)) if fallback else F.array().cast("array<string>")
    return F.when(F.coalesce(trimmed(text), F.lit("")) == "", F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(rest)


def family_of(code: Column, prefixes: list[tuple[str, str]] = (), exact: list[tuple[str, str]] = ()) -> Column:
    """Family of an edition code without its year: the first listed prefix, then an exact name, then the code itself."""
    base = code_family(_text(code))
    rules = [(base.startswith(p), f) for p, f in prefixes if p] + [(base == n, f) for n, f in exact]
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), base)


def ring_of(code: Column, families: list[tuple[str, str]]) -> Column:
    """Display family: of a listed code itself or of its dashed extensions; else the code."""
    rules = [((code == p) | code.startswith(p + "-"), f) for p, f in families]
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), code)


def number_text(value: Column, digits: int = 2) -> Column:
    """Rounded to so many decimals (ties of the binary value to even), without trailing zeros; ``0`` for what rounds to none."""
    text = F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))
    bare = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(bare.isin("-0", ""), "0").otherwise(bare)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


# --- credits


def latin_personal_form(c: Column) -> Column:
    """A trailing bracket without letters of another script dropped, ``Surname, Given`` turned round."""
    v = trimmed(_text(c))
    ends = r"^([\p{IsLatin}\p{M}\p{N}\p{P}\p{S}\s\p{Z}]*[\p{IsLatin}][\p{IsLatin}\p{M}\p{N}\p{P}\p{S}\s\p{Z}]*?)\s*[(\[（［]([^()\[\]（）［］]*)[)\]）］]\s*$"
    inside = F.regexp_extract(v, ends, 2)
    cut = F.when(v.rlike(ends) & ~inside.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), trimmed(F.regexp_extract(v, ends, 1))).otherwise(v)
    parts = F.transform(F.split(cut, ","), trimmed)
    turned = F.concat(F.get(parts, 1), F.lit(" "), F.get(parts, 0))
    return F.when((F.size(parts) == 2) & (F.get(parts, 0) != "") & (F.get(parts, 1) != ""), turned).otherwise(cut)


def person_like(c: Column) -> Column:
    """Two to four Hangul syllables, or two to six Latin words."""
    return c.rlike("^[가-힣]{2,4}$") | c.rlike(r"^[\p{IsLatin}.'’-]+(?:\s+[\p{IsLatin}.'’-]+){1,5}$")


def credit(c: Column) -> Column:
    """(name_ko, name_en, aliases, kind) of a roster credit.

    One personal name in brackets is that person with the outer name as alias, one
    other name an alias of a person outside; several names, or a credit joined by a
    sign, are a group and its members.
    """
    text = trimmed(F.regexp_replace(_text(c), SPACES, " "))
    shape = r"^(.*?)\s*[(（]([^)）]+)[)）]\s*$"
    outer, inner = trimmed(F.regexp_extract(text, shape, 1)), trimmed(F.regexp_extract(text, shape, 2))
    members = F.filter(F.transform(F.split(inner, "[,、]"), trimmed), lambda x: x != "")
    one, first = F.size(members) == 1, F.get(members, 0)
    none = F.array().cast("array<string>")
    is_ = lambda name, aliases, kind: F.struct(F.when(name.rlike(HANGUL), name).otherwise("").alias("name_ko"), F.when(name.rlike(HANGUL), "").otherwise(name).alias("name_en"), aliases.alias("aliases"), F.lit(kind).alias("kind"))
    return (
        F.when(text.rlike(shape) & one & person_like(first), is_(first, F.array(outer), "individual"))
        .when(text.rlike(shape) & one & person_like(outer), is_(outer, members, "individual"))
        .when(text.rlike(shape), is_(outer, members, "group"))
        .when(text.rlike(r"\s[&+x×]\s|&"), is_(text, none, "group"))
        .otherwise(is_(text, none, "individual"))
    )


def credit_members(c: Column) -> Column:
    """Members of a group credit: the names in brackets, or the parts around joining signs; none for one person."""
    got = credit(c)
    parts = F.filter(F.transform(F.split(trimmed(F.regexp_replace(_text(c), SPACES, " ")), r"\s*(?:&|\sx\s|\sX\s|·|\+)\s*"), trimmed), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(got["kind"] != "group", none).when(F.size(got["aliases"]) > 0, got["aliases"]).when(F.size(parts) >= 2, parts).otherwise(none)


def noted_members(note: Column) -> Column:
    """Names of the ``members=`` part of a note, parted by bars or commas."""
    cell = F.regexp_extract(_text(note), r"(?:^|;\s*)members=([^;]*)", 1)
    return F.filter(F.transform(F.split(cell, r"\s*[|,]\s*"), lambda x: trimmed(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")
