"""Intervals, gates and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: standard normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; null where n is 0."""
    m = n.cast("double")
    p = hits / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    margin = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - margin)), F.when(some, F.least(F.lit(1.0), centre + margin))


def round_to_5(n: Column) -> Column:
    return (5 * F.floor((n + 2) / 5)).cast("long")


def quantile_allowed(n: Column, q: float, k: int = 10) -> Column:
    """A quantile may be shown if its smaller side holds ``k`` entities."""
    return n * min(q, 1 - q) + 1e-9 >= k


def gate_share(share: Column, n: Column, least: int = 20) -> Column:
    return F.when(n >= least, share)


def outward(lo: Column, hi: Column, digits: int = 2) -> tuple[Column, Column]:
    """Bounds rounded away from each other."""
    m = 10**digits
    return F.floor(lo * m + 1e-9) / m, F.ceil(hi * m - 1e-9) / m


def safe_share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
