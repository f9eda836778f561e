"""Semantics that differ between engines: half-even rounding, floor division, null order, truthiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(x: Column, digits: int = 0) -> Column:
    """Round half to even on the shortest decimal form of a double."""
    return F.bround(x, digits)


def round_even(x: Column, digits: int = 0) -> Column:
    """As SQL's round_even: half to even of the product in doubles, so what comes next to a half by its last bits is one."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def floor_div(a: Column, b: int) -> Column:
    """Division that rounds towards minus infinity."""
    return F.floor(a / F.lit(b)).cast("int")


def nullif_zero(x: Column) -> Column:
    """0 counts as absent."""
    return F.nullif(x, F.lit(0))


def nullif_blank(x: Column) -> Column:
    """'' counts as absent."""
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at both ends; trim alone takes off blanks only."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def present(x: Column) -> Column:
    """Neither null nor 0."""
    return F.coalesce(x != 0, F.lit(False))


def asc(c: str | Column) -> Column:
    """Ascending with nulls last, as an unqualified sort elsewhere."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    """Descending with nulls first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def array_length(a: Column) -> Column:
    """Null for an empty array."""
    return F.nullif(F.array_size(a), F.lit(0))


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(*conditions: Column) -> Column:
    """The conjunction of the conditions; true if there is none."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
