"""Several values packed in one cell: split, keep order, honour quotes.

The cell is split on quote characters. Odd pieces are literals; even pieces are
split on delimiters; array functions put the values back together with their
ordinals. Everything is a column expression, so the scan, the split and the
explode stay in one stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks: value boundary, start and end of a literal. Removed from the input first.
CUT, OPEN, CLOSE = "\u0001", "\u0002", "\u0003"
SPACE = r"[\s\p{Z}]"
#: Name lists: every listed sign separates.
ALIAS_DELIMITERS = r"[,，;；|｜/／、\t\n\r]"
#: Venue cells: a comma, bracket, hyphen, tab or an unspaced slash belongs to the value.
VENUE_DELIMITERS = rf"[;；|｜、→\n\r]|{SPACE}+/{{1,2}}(?={SPACE})|//|/{SPACE}*$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def split_values(cell: Column, delimiters: str, comma_between_quotes: bool = False) -> Column:
    """Array of the values of ``cell``; null for a null cell, empty for a blank one.

    ``comma_between_quotes``: a comma standing alone between two quoted values
    separates even where an unquoted comma does not. A doubled quote inside a
    quoted value is one quote; a quote that is never closed is ordinary text.
    """
    plain = F.translate(cell, f"“”{CUT}{OPEN}{CLOSE}", '""')
    pieces = F.split(plain, '"', -1)
    last = F.size(pieces) - 1

    def piece(x: Column, i: Column) -> Column:
        parted = F.regexp_replace(x, delimiters, CUT)
        if comma_between_quotes:
            lone = (i > 0) & (i < last) & x.rlike(rf"^{SPACE}*[,，]{SPACE}*$")
            parted = F.when(lone, F.lit(CUT)).otherwise(parted)
        unclosed = (i == last) & (i % 2 == 1)
        return F.when(unclosed, F.concat(F.lit('"'), F.regexp_replace(x, delimiters, CUT))).when(i % 2 == 0, parted).otherwise(F.concat(F.lit(OPEN), x, F.lit(CLOSE)))

    joined = F.replace(F.array_join(F.transform(pieces, piece), ""), F.lit(CLOSE + OPEN), F.lit('"'))
    values = F.transform(F.split(joined, CUT, -1), lambda v: _unquoted(trimmed(v)))
    # a cell without any quote or delimiter is its own only value
    return F.filter(values, lambda v: v != "")


def _unquoted(v: Column) -> Column:
    whole = v.rlike(f"^{OPEN}[^{OPEN}{CLOSE}]*{CLOSE}$")
    return F.when(whole, trimmed(F.translate(v, OPEN + CLOSE, ""))).otherwise(F.translate(v, OPEN + CLOSE, '""'))


def alias_values(cell: Column) -> Column:
    return split_values(cell, ALIAS_DELIMITERS)


def venue_values(cell: Column) -> Column:
    return split_values(cell, VENUE_DELIMITERS, comma_between_quotes=True)


#: A cell without any of these signs cannot hold two values.
ALIAS_MAY_SPLIT = ALIAS_DELIMITERS
VENUE_MAY_SPLIT = rf"{VENUE_DELIMITERS}|[\"“”]"


def packed_rows(df: DataFrame, row_id: str, cell: str, src_table: str, kind: str) -> DataFrame:
    """One row per value of each cell of two or more values: (src_table, row_id, pos, item).

    Null, blank and single-valued cells give no row; repeated values keep their
    own positions; other columns of ``df`` are ignored. An empty table gives none.
    """
    values, may = (alias_values, ALIAS_MAY_SPLIT) if kind == "alias" else (venue_values, VENUE_MAY_SPLIT)
    src = df.select(F.col(row_id).alias("row_id"), F.col(cell).alias("cell")).filter(F.col("cell").rlike(may))
    got = src.select("row_id", values(F.col("cell")).alias("v")).filter(F.size("v") >= 2)
    return got.select(F.lit(src_table).alias("src_table"), "row_id", F.posexplode("v").alias("p", "item")).select("src_table", "row_id", (F.col("p") + 1).cast("int").alias("pos"), "item")
