"""Small column expressions with the rounding and null rules used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(col: str | Column) -> Column:
    """The column as a double, with NaN read as missing."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def half_even(col: Column, digits: int = 2) -> Column:
    """Round half to even, as numeric reports expect."""
    return F.bround(col, digits)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the divisor is zero (plain division raises under ANSI)."""
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / max(whole, 1) as a rounded percentage."""
    return half_even(part / F.greatest(whole, F.lit(1)) * 100.0, digits)


def relative_change(start: Column, end: Column) -> Column:
    """(end - start) / max(|start|, 1e-10) * 100."""
    return (end - start) / F.greatest(F.abs(start), F.lit(1e-10)) * 100.0


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def total(col: Column) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0.0))
