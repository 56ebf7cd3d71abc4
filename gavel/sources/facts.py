"""Facts and evidence from JSON documents and from observations, and collections inside JSON files."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, hashing, json_values, numbers
from ..functions import text as texts
from .shared import folder

FULL_PAGE = {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}
VALUES = {"STRING": "v_string", "NUMBER": "v_number", "BOOLEAN": "v_boolean", "DATE": "v_date", "JSON": "v_json"}


def _read(t: Column, form: Column, kind: str) -> Column:
    """The value of a type as text in one form, of a value's ``struct(kind, raw, number, json)`` and the NFKC form of a text
    beyond ASCII; null where it cannot be read as that."""
    raw, is_text = t["raw"], t["kind"] == "STRING"
    if kind == "STRING":
        return F.when(is_text, texts.collapse(F.coalesce(form, raw)))
    if kind == "NUMBER":
        number = F.when(is_text, numbers.normalize_decimal(raw)).otherwise(t["number"])
        return F.transform(F.array(number), lambda n: F.when(numbers.valid_number(n) | (n == 0), n + 0.0).cast("string"))[0]
    if kind == "BOOLEAN":
        return F.when(t["kind"] == "BOOLEAN", raw)
    if kind == "DATE":
        return F.when(is_text, dates.normalize_iso_date(raw))
    if kind == "JSON":
        return t["json"]
    raise ValueError(f"unknown type {kind}")


def _nfkc(listed: Column) -> Column:
    """NFKC of each of an array of texts."""

    @F.pandas_udf("array<string>")
    def formed(many: pd.Series) -> pd.Series:
        return many.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])

    return formed(listed)


def observations_from_json(docs: DataFrame, mappings: list[dict], body: str = "body") -> DataFrame:
    """One row for each document and mapping, with the other columns of the document: fact_key, value_type, status,
    value (as text), raw_confidence, ``evidence`` and ``candidates``.

    A mapping has ``key``, ``type``, ``pointers`` and maybe a ``box``.  Nothing found: NOT_FOUND; only JSON nulls:
    NULL; something unreadable, or nulls beside values: NOT_READABLE; values that differ: CONFLICT with a candidate
    for each; else RESOLVED.  Documents that are not JSON have nothing.  What the pointers find becomes rows
    first, a mapping each, so that a value is read by one expression of the row, however many mappings there are;
    nothing is shuffled.
    """
    kinds = list(dict.fromkeys(m["type"] for m in mappings))
    if unknown := set(kinds) - set(VALUES):
        raise ValueError(f"unknown type {min(unknown)}")
    rows = docs.withColumn("_v", json_values.parsed(F.col(body)))
    keep = [c for c in docs.columns if c != body]
    shown = []
    for m in mappings:
        at = F.filter(F.array(*[json_values.variant_at(F.col("_v"), p) for p in m["pointers"]]), lambda v: v.isNotNull())
        box = F.struct(*[F.lit(float({**FULL_PAGE, **m.get("box", {})}[k])).alias(k) for k in FULL_PAGE])
        shown.append(F.struct(F.lit(m["key"]).alias("fact_key"), F.lit(m["type"]).alias("value_type"), box.alias("_box"), at.alias("_at")))
    rows = rows.select(*keep, F.explode(F.array(*shown)).alias("_m")).select(*keep, "_m.*")
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    told = lambda v: F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("raw"), F.when(F.col("value_type") == "NUMBER", number(v)).alias("number"), F.to_json(v).alias("json"), F.is_variant_null(v).alias("empty"))
    rows = rows.withColumn("_told", F.transform("_at", told)).drop("_at")
    # Texts beyond ASCII are the only ones that go to Python.
    beyond = F.transform("_told", lambda t: F.when((F.col("value_type") == "STRING") & (t["kind"] == "STRING") & (F.octet_length(t["raw"]) > F.char_length(t["raw"])), t["raw"]))
    # None are an empty array: Arrow's size of a batch goes through all its null arrays again for each row.
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_formed", _nfkc(F.when(F.exists(beyond, lambda x: x.isNotNull()), beyond).otherwise(none)) if "STRING" in kinds else none)

    def one(t: Column, i: Column) -> Column:
        value = F.lit(None).cast("string")
        for kind in kinds:
            value = F.when(F.col("value_type") == kind, _read(t, F.get("_formed", i), kind)).otherwise(value)
        return F.struct(t["empty"].alias("empty"), value.alias("value"), F.struct(texts.bounded_text(t["json"]).alias("text"), F.col("_box").alias("box")).alias("evidence"))

    rows = rows.select(*keep, "fact_key", "value_type", F.transform("_told", one).alias("found"))
    found = F.col("found")
    full = F.filter(found, lambda x: ~x["empty"])
    unread = F.exists(full, lambda x: x["value"].isNull())
    status = (
        F.when(F.size(found) == 0, "NOT_FOUND").when(F.size(full) == 0, "NULL").when(unread | (F.size(full) < F.size(found)), "NOT_READABLE")
        .when(F.size(F.array_distinct(F.transform(full, lambda x: x["value"]))) > 1, "CONFLICT").otherwise("RESOLVED")
    )
    rows = rows.withColumn("status", status)
    one, many = F.col("status") == "RESOLVED", F.col("status") == "CONFLICT"
    return rows.withColumns({
        "value": F.when(one, F.get(found, 0)["value"]), "raw_confidence": F.when(one, 1.0), "evidence": F.filter(F.transform(found, lambda x: x["evidence"]), lambda x: ~many),
        "candidates": F.filter(F.transform(found, lambda x: F.struct(x["value"].alias("value"), F.lit(1.0).alias("raw_confidence"), F.array(x["evidence"]).alias("evidence"))), lambda x: many)}).drop("found")


def materialize_observations(observations: DataFrame, case: str = "case_id", run: str = "run-A") -> tuple[DataFrame, DataFrame]:
    """Facts and evidence of observations, linked by ids that follow from the run, the case, the key and the place.

    A fact is evidenced by its own evidence and, if in CONFLICT, that of its candidates too; only RESOLVED ones have values.
    """
    place = lambda *parts: hashing.deterministic_uuid(F.concat_ws("|", F.lit(run), F.col(case).cast("string"), "fact_key", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))
    numbered = observations.withColumns({
        "_top": F.transform("evidence", lambda e, i: F.struct(place("e", i).alias("evidence_id"), e["text"].alias("text"), e["box"].alias("box"))),
        "_more": F.transform("candidates", lambda c, i: F.struct(place("c", i).alias("id"), c["value"].alias("value"), c["raw_confidence"].alias("raw_confidence"), F.transform(c["evidence"], lambda e, j: F.struct(place("ce", i, j).alias("evidence_id"), e["text"].alias("text"), e["box"].alias("box"))).alias("evidence"))),
    })
    ids = lambda es: F.transform(es, lambda e: e["evidence_id"])
    all_of = F.concat("_top", F.flatten(F.transform("_more", lambda c: c["evidence"])))
    resolved = F.col("status") == "RESOLVED"
    typed = {name: F.when(resolved & (F.col("value_type") == kind), F.col("value").cast({"NUMBER": "double", "BOOLEAN": "boolean"}.get(kind, "string"))) for kind, name in VALUES.items()}
    facts = numbered.select(
        case, place("fact").alias("fact_id"), "fact_key", "value_type", "status", *[c.alias(n) for n, c in typed.items()], F.when(F.col("status") == "CONFLICT", ids(all_of)).otherwise(ids(F.col("_top"))).alias("evidence_ids"),
        F.transform("_more", lambda c: F.struct(c["id"].alias("id"), c["value"].alias("value"), ids(c["evidence"]).alias("evidence_ids"), F.lit(run).alias("provider_run_id"), c["raw_confidence"].alias("raw_confidence"))).alias("candidates"),
        F.lit(run).alias("provider_run_id"), "raw_confidence")
    evidence = numbered.select(case, F.explode(all_of).alias("e")).select(case, "e.evidence_id", "e.text", "e.box", F.lit(run).alias("provider_run_id"))
    return facts, evidence


def facts_from_json(docs: DataFrame, mappings: list[dict], case: str = "case_id", body: str = "body", run: str = "run-A") -> tuple[DataFrame, DataFrame]:
    """Facts and evidence straight from JSON documents, ready for ``evaluate.by_case``.  Documents are dealt by case first, so
    that a few files are read by all tasks.  What is observed is written to the shared folder, so that facts and evidence,
    and all that is made of them, neither read the documents again nor have the reading in their plans, which the driver
    holds as often as they are used."""
    path = f"{folder(docs.sparkSession)}/observations"
    observed = observations_from_json(docs.select(case, body).repartition(case), mappings, body)
    observed.write.parquet(path)
    return materialize_observations(docs.sparkSession.read.schema(observed.schema).parquet(path), case, run)


def read_json_collection(files: DataFrame, pointer: str, aggregate_rows: bool = False, body: str = "body") -> DataFrame:
    """The items of the array at a pointer, a row each: the other columns, valid, position, item (JSON).

    With ``aggregate_rows`` a file has a JSON value on each line, and the arrays of all lines follow each other; one
    line without an array at the pointer makes the file invalid.  An invalid file is one row without an item, an empty array too.
    """
    keep = [c for c in files.columns if c != body]
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "") if aggregate_rows else F.array(body)
    arrays = F.transform(lines, lambda x: F.try_variant_get(json_values.variant_at(json_values.parsed(x), pointer), "$", "array<variant>"))
    rows = files.select(*keep, arrays.alias("_a"))
    valid = F.coalesce((F.size("_a") > 0) & ~F.exists("_a", lambda x: x.isNull()), F.lit(False))
    rows = rows.select(*keep, valid.alias("valid"), F.posexplode_outer(F.when(valid, F.flatten(F.transform("_a", lambda a: F.transform(a, lambda x: F.to_json(x)))))).alias("position", "item"))
    return rows
