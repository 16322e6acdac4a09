"""Years, cohorts, bands and right-censoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First ages of the bands; the last is open.
BAND_STARTS = (0, 3, 6, 11, 21)


def year_of(c: Column) -> Column:
    """First year 1900 to 2099 standing in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"(19[0-9]{2}|20[0-9]{2})", 1), F.lit("")).cast("int")


def code_year(c: Column) -> Column:
    """Year ending an edition code, or null for an undated code."""
    return F.nullif(F.regexp_extract(c, r"-([0-9]{4})$", 1), F.lit("")).cast("int")


def code_family(c: Column) -> Column:
    return F.regexp_replace(c, r"-[0-9]{4}$", "")


def generation_of(y: Column, width: int = 5, anchor: int = 2000) -> Column:
    """First year of the bin, floored on both sides of the anchor."""
    return (anchor + width * F.floor((y - anchor) / width)).cast("int")


def band_of(age: Column, starts: tuple[int, ...] = BAND_STARTS) -> Column:
    """Label of the age band; null below the first."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(starts, (*starts[1:], None)):
        out = F.when(age >= lo, F.lit(f"{lo}-{hi - 1}" if hi is not None else f"{lo}+")).otherwise(out)
    return out


def reached(first: Column, age: Column | int, now: int) -> Column:
    """Right-censoring: the entity could have been observed at this age."""
    return first + age <= now


def window_open(first: Column, age: Column | int, now: int, width: int = 3) -> Column:
    return first + age + width <= now
