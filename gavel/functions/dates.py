"""Dates as ISO texts, instants at full precision, and half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANT = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?Z$"


def valid_iso_date(c: Column) -> Column:
    """A calendar date written YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False)) & c.isNotNull()


def compare_date(a: Column, b: Column) -> Column:
    """ISO dates order as texts; null unless both are valid."""
    return F.when(valid_iso_date(a) & valid_iso_date(b), F.when(a < b, -1).when(a == b, 0).otherwise(1))


def utc_key(c: Column) -> Column:
    """A sortable struct of an instant ending in Z: its minute or second, then the digits of its fraction
    without zeros at the end.  Any number of digits counts; seconds may be missing."""
    part = lambda i: F.regexp_extract(c, INSTANT, i)
    second = F.when(part(4) == "", "00").otherwise(part(4))
    moment = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3), F.lit(":"), second, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.when(c.rlike(INSTANT) & moment.isNotNull(), F.struct(F.unix_timestamp(moment).alias("second"), F.regexp_replace(part(5), "0+$", "").alias("fraction")))


def compare_utc(a: Column, b: Column) -> Column:
    x, y = utc_key(a), utc_key(b)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def in_interval(t: Column, start: Column, end: Column) -> Column:
    """start <= t < end; a null end is open."""
    return (start.isNull() | (start <= t)) & (end.isNull() | (t < end))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals that share a point; null ends are open."""
    return (a_end.isNull() | b_start.isNull() | (b_start < a_end)) & (b_end.isNull() | a_start.isNull() | (a_start < b_end))


def normalize_iso_date(c: Column) -> Column:
    return F.when(valid_iso_date(c), c)


def normalize_utc_datetime(c: Column) -> Column:
    """An instant with an offset as UTC with milliseconds, whatever the session's zone; null for other forms."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    millis = F.unix_millis(F.try_to_timestamp(F.regexp_replace(c, r"(\.\d{3})\d+", "$1")))
    second = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(millis / 1000).cast("decimal(18,6)"))
    return F.when(c.rlike(form), F.concat(F.replace(second.cast("string"), F.lit(" "), F.lit("T")), F.lit("."), F.lpad(F.pmod(millis, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z")))
