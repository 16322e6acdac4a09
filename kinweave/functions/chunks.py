"""Long texts in pieces, and values found in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = re.compile(r"^(?:#{1,6}\s+\S.*|[^\n.!?]{1,40}:?)$")


def pieces(text: str, most: int = 4000) -> list[str]:
    """Pieces of at most ``most`` characters, cut at blank lines, then lines, then anywhere; a heading is repeated in its later pieces."""
    out: list[str] = []
    heading, current, fresh = "", "", False

    def close() -> None:
        """End the piece, unless it holds no more than a repeated heading."""
        nonlocal current, fresh
        if fresh and current.strip():
            out.append(current.strip())
        current = heading if len(heading) + 1 < most else ""
        fresh = False

    for para in re.split(r"\n\s*\n", text):
        first = para.strip().split("\n", 1)[0]
        if current and len(current) + len(para) + 2 > most and fresh:
            close()
        for line in [para] if len(current) + len(para) + 2 <= most else para.split("\n"):
            if fresh and len(current) + len(line) + 1 > most:
                close()
            while len(current) + len(line) + 1 > most:
                room = max(1, most - len(current) - 1)
                current, fresh, line = f"{current}\n{line[:room]}" if current else line[:room], True, line[room:]
                close()
            if line.strip():
                current, fresh = f"{current}\n{line}" if current else line, True
        current += "\n" if current else ""
        if HEADING.match(first) and len(first) < 60:
            heading = first
    close()
    return out


def split_text(c: Column, most: int = 4000) -> Column:
    """Array of pieces; null for a null text, empty for a blank one."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: pieces(t, most) if isinstance(t, str) else None)

    return run(c)


def year_in(text: Column, year: Column) -> Column:
    """The year stands in the text as a number of its own."""
    return F.array_contains(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1)), year.cast("string"))


def phrase_in(text: Column, phrase: Column) -> Column:
    """The words of the phrase stand in the text in order, whatever the signs between them; an empty phrase does not."""
    flat = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return (F.length(flat(phrase)) > 2) & F.contains(flat(text), flat(phrase))


def failures(text: Column, title: Column, venue: Column, year: Column) -> Column:
    """Which of year, venue and (only without a venue) title the source text does not hold."""
    no_venue = F.coalesce(F.trim(venue), F.lit("")) == ""
    return F.array_compact(F.array(F.when(year.isNotNull() & ~F.coalesce(year_in(text, year), F.lit(False)), "year"), F.when(~no_venue & ~F.coalesce(phrase_in(text, venue), F.lit(False)), "venue"), F.when(no_venue & ~F.coalesce(phrase_in(text, title), F.lit(False)), "title")))
