"""Text helpers with Python string semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Treat an empty string like a missing value."""
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    """First value that is neither missing nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def strip(c: Column) -> Column:
    """Remove every kind of leading and trailing whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clipped(length: Column, offset: Column, limit: int) -> Column:
    """How much of a piece of ``length`` starting at ``offset`` lies below ``limit``."""
    return F.greatest(F.lit(0), F.least(length, F.lit(limit) - offset))


def join_ints(a: Column) -> Column:
    """Readable form of an integer array."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
