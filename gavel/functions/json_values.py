"""Values inside JSON texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """A variant of a text that is one JSON value and nothing else; null for others."""
    return F.when(F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1, F.try_parse_json(c))


def _step(v: Column, step: str) -> Column:
    """The member of an object, or for digits (without leading zero) also the item of an array."""
    quote = '"' if "'" in step else "'"
    if quote in step:
        raise ValueError(f"a step with both kinds of quotes: {step!r}")
    member = F.try_variant_get(v, f"$[{quote}{step}{quote}]", "variant")
    return F.coalesce(F.try_variant_get(v, f"$[{step}]", "variant"), member) if re.fullmatch("0|[1-9][0-9]*", step) else member


def variant_at(v: Column, pointer: str) -> Column:
    """What an RFC 6901 pointer finds in a variant; null if nothing."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    for step in pointer.split("/")[1:]:
        v = _step(v, step.replace("~1", "/").replace("~0", "~"))
    return v


def variant_text(v: Column) -> Column:
    """A string as it is, other values as JSON, a JSON null as null."""
    return F.when(~F.is_variant_null(v), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def json_pointer(c: Column, pointer: str) -> Column:
    """``struct(found, value)``: a JSON null is found with a null value."""
    v = variant_at(F.try_parse_json(c), pointer)
    return F.struct(v.isNotNull().alias("found"), variant_text(v).alias("value"))


def is_non_empty(c: Column) -> Column:
    """A string that is not blank, an array or an object with members."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string")) != "")
        .when(kind.startswith("ARRAY"), F.json_array_length(c) > 0)
        .when(kind.startswith("OBJECT"), F.size(F.json_object_keys(c)) > 0)
        .otherwise(F.lit(False)),
        F.lit(False),
    )
