"""Numbers and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = float(2**53 - 1)
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def valid_number(c: Column) -> Column:
    """Finite, not negative zero, and whole numbers within 2^53 - 1."""
    c = c.cast("double")
    return ~F.isnan(c) & (F.abs(c) != float("inf")) & (c.cast("string") != "-0.0") & ((c != F.floor(c)) | (F.abs(c) <= SAFE))


def compare_number(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null unless both are valid."""
    return F.when(valid_number(a) & valid_number(b), F.when(a < b, -1).when(a == b, 0).otherwise(1))


def between(c: Column, low, high, with_low: bool = True, with_high: bool = True) -> Column:
    """Range test; a reversed or empty range is an error, told as null."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    inside = ((c >= low) if with_low else (c > low)) & ((c <= high) if with_high else (c < high))
    holds = (low <= high) if with_low and with_high else (low < high)
    return F.when(holds, inside)


def normalize_decimal(c: Column) -> Column:
    """Strict decimal text to a double; null for other forms and unsafe whole numbers; -0 is 0."""
    value = F.when(c.rlike(DECIMAL), F.expr("1") * c.try_cast("double"))
    return F.when(valid_number(value) | (value == 0), value + 0.0)
