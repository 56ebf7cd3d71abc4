"""String functions: Column in, Column out; null in, null out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}+"
ZERO_WIDTH = "﻿"


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """NFC or NFKC.  Spark has no such function, so batches of texts go through Arrow."""

    @F.pandas_udf("string")
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return formed(c)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; blanks and U+FEFF at the ends go."""
    return F.btrim(F.regexp_replace(c, WHITE, " "), F.lit(f" {ZERO_WIDTH}"))


def normalize_text(c: Column, form: str | None = "NFC", white: bool = True, fold: bool = True) -> Column:
    """Unicode form, then white space, then lower case."""
    c = unicode_form(c, form) if form else c
    c = collapse(c) if white else c
    return F.lower(c) if fold else c


def normalize_unicode(c: Column) -> Column:
    """NFKC with collapsed white space; case stays."""
    return collapse(unicode_form(c, "NFKC"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; strings by code point (the order of UTF-8 bytes)."""
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def text_contains(c: Column, part: Column, **options) -> Column:
    """Substring test after normalisation; a part that normalises to nothing is an error, told as null."""
    part = normalize_text(part, **options)
    return F.when(part != "", normalize_text(c, **options).contains(part))


def text_equals(a: Column, b: Column, **options) -> Column:
    return normalize_text(a, **options) == normalize_text(b, **options)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which limits are given."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def citation(c: Column, longest: int = 280) -> Column:
    """The text itself, or its first ``longest`` - 3 characters without blanks at the end and an ellipsis."""
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, longest - 3), r"\s+$", ""), F.lit("…")))


def bounded_text(c: Column, longest: int = 20_000) -> Column:
    """Texts over the limit are cut so that they reach it together with a note of the hash and length of
    the whole.  Lengths are in UTF-16 units; no surrogate pair is cut in two."""
    units = utf16_length(c).cast("long")
    note = F.concat(F.lit("\n...[truncated; sha256="), F.sha2(c, 256), F.lit("; originalCharacters="), units.cast("string"), F.lit("]"))
    room = (longest - F.length(note)).cast("int")
    coded = F.encode(c, "UTF-16BE")
    split = F.hex(F.substring(coded, 2 * room - 1, 1)).between("D8", "DB")
    return F.when(units <= longest, c).otherwise(F.concat(F.decode(F.substring(coded, F.lit(1), 2 * F.when(split, room - 1).otherwise(room)), "UTF-16BE"), note))


def language_matches(a: Column, b: Column, mode: str = "EXACT") -> Column:
    """Language tags without case: whole, or their primary subtags."""
    if mode == "PRIMARY":
        a, b = F.split_part(a, F.lit("-"), F.lit(1)), F.split_part(b, F.lit("-"), F.lit(1))
    return F.lower(a) == F.lower(b)


def safe_reference(value: Column, base: Column) -> Column:
    """``base/value`` as a relative path; null for a backslash, a leading slash or a step upwards."""
    bad = value.contains("\\") | value.startswith("/") | value.rlike(r"(^|/)\.\.(/|$)") | (value == "")
    clean = F.regexp_replace(F.regexp_replace(value, r"(^|/)(\./)+", "$1"), "/{2,}", "/")
    return F.when(~bad, F.when(F.coalesce(base, F.lit("")) == "", clean).otherwise(F.concat_ws("/", base, clean)))
