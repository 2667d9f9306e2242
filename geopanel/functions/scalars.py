"""Scalar expressions: casting, keys, dates, clipping, rates and rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_int(c: str | Column, tokens: tuple[str, ...] = ("*", "N/D")) -> Column:
    """Suppression tokens become NULL, anything unparseable too."""
    cleaned = reduce(lambda acc, t: F.nullif(acc, F.lit(t)), tokens, col(c))
    return cleaned.try_cast("int")


def unit_key(state: str, *parts: str | Column) -> Column:
    return F.concat(F.lit(state), *[col(p) for p in parts])


def group_of_key(key: str | Column) -> Column:
    """Characters 3-5 of a unit key."""
    return F.substring(col(key), 3, 3)


def padded_group(code: str | Column) -> Column:
    """``9002`` -> ``002``: drop the state digit, left-pad to three."""
    return F.lpad(F.substring(col(code), 2, 20), 3, "0")


def age_label(c: str | Column) -> Column:
    """``POB_010_014`` -> ``10_14``; two-digit ages keep their form."""
    bare = F.regexp_replace(col(c), "^POB_", "")
    return F.regexp_replace(bare, "^0(\\d\\d)_0(\\d\\d)$", "$1_$2")


def edition_label(path: str | Column) -> Column:
    """``…_2016_10.csv`` -> ``2016-10``: the file's own name decides, else its folder's, never one further up. A name
    without a date is its own label, without its ending."""
    p = col(path)
    date = lambda name: F.nullif(F.regexp_extract(name, r"(?<!\d)(\d{4})_(\d{2})(?!\d)", 0), F.lit(""))
    # Cut at slashes, not by a pattern: one that ends in ``$`` is tried at every character of the path, for every row of a file.
    own, folder = F.substring_index(p, "/", -1), F.substring_index(F.substring_index(p, "/", -2), "/", 1)
    return F.coalesce(F.translate(F.coalesce(date(own), date(folder)), "_", "-"), F.regexp_replace(own, r"\.[^.]*$", ""))


def decimal_year(label: str | Column) -> Column:
    """``YYYY-MM`` -> year + (month - 0.5) / 12; a bare year counts as June."""
    parts = F.split(col(label), "-")
    month = F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(6.0))
    return F.get(parts, F.lit(0)).try_cast("double") + (month - 0.5) / 12.0


def horizon_years(explicit: str | Column, label: str | Column, issued: str | Column) -> Column:
    """Explicit years win; else whole years between two ``YYYY-MM`` labels, at least one."""
    target, start = F.split(col(label), "-"), F.split(col(issued), "-")
    part = lambda a, i, d: F.coalesce(F.get(a, F.lit(i)).try_cast("int"), F.lit(d))
    months = (part(target, 0, None) - part(start, 0, None)) * 12 + (part(target, 1, 6) - part(start, 1, 6))
    rounded = F.floor(months / 12.0 + 0.5).cast("int")
    derived = F.when(months.isNotNull(), F.greatest(F.lit(1), rounded))
    return F.coalesce(col(explicit).cast("int"), derived)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Bounds that let NULL through (``greatest``/``least`` alone would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def per_thousand(s: str | Column, d: str | Column) -> Column:
    """``s / d * 1000``; NULL without a positive denominator, 0 stays 0."""
    s, d = col(s).cast("double"), col(d).cast("double")
    return F.when(d > 0, F.try_divide(s, d) * 1000.0)


def log_rate(d0: str | Column, d1: str | Column, dt: float | Column) -> Column:
    return F.log((col(d1) + 0.5) / (col(d0) + 0.5)) / dt


def log_rate_variance(d0: str | Column, d1: str | Column, dt: float | Column, thin: float | Column = 1.0) -> Column:
    """Poisson variance of :func:`log_rate`; ``thin`` < 1 inflates the later count's share."""
    later = F.lit(1.0) / ((col(d1) + 0.5) * thin)
    return (later + F.lit(1.0) / (col(d0) + 0.5)) / (dt * dt)


def implied_rate_pct(base: str | Column, later: str | Column, years: float) -> Column:
    """Annual %-rate between two summed levels: 0 from nothing, -100 to nothing."""
    b, h = col(base), col(later)
    return (
        F.when(b.isNull() | h.isNull(), None)
        .when(b <= 0, F.lit(0.0))
        .when(h <= 0, F.lit(-100.0))
        .otherwise(F.log(h / b) * 100.0 / years)
    )


def level_at_horizon(base: str | Column, delta_pct: str | Column) -> Column:
    """Missing base is a legitimate zero, missing change keeps the base."""
    return F.coalesce(col(base) * (F.coalesce(col(delta_pct), F.lit(0.0)) / 100.0 + 1.0), F.lit(0.0))


def half_even(c: str | Column, digits: int) -> Column:
    return F.bround(col(c), digits)


def array_of(values: list | tuple, kind: str = "double") -> Column:
    """Literal dimension as an array, ready for ``explode``."""
    return F.array(*[F.lit(v).cast(kind) for v in values])
