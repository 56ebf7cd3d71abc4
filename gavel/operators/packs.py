"""Evaluation of versions of rule packs: many versions in one job, each case under its own."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_interval
from .evaluate import evaluate_rules, outcomes
from .ledgers import resolve_pack
from .programs import table
from .resolution import Pack, resolve_findings

#: Version of what a snapshot's hash is made of, and what it is meant for; fixed values.
SNAPSHOT, SCOPE = "1.0.0", "TECHNICAL_DEMO"


@dataclass
class Version:
    """A version of a pack: its rules (see ``evaluate``), relations, validity (half open) and content hash."""

    version_id: str
    content_hash: str
    rules: list[dict]
    valid_from: str
    valid_to: str | None = None
    declared: list[tuple[str, str]] = field(default_factory=list)
    norms: dict[str, tuple[str, str]] = field(default_factory=dict)


VERSION = pa.schema([("version_id", pa.string()), ("version_hash", pa.string()), ("valid_from", pa.string()), ("valid_to", pa.string())])


def snapshot_hash(date: Column) -> Column:
    """sha256 of the canonical JSON of a snapshot: version, date, outcome, and findings by rule."""
    finding = lambda x: F.struct(*[x[c].alias(c) for c in ("effective", "outcome", "related", "resolution", "rule_id")])
    findings = F.transform(F.array_sort("resolved", lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0)), finding)
    return F.sha2(F.to_json(F.struct(date.alias("evaluation_date"), findings.alias("findings"), "outcome", F.lit(SNAPSHOT).alias("schema_version"), F.lit(SCOPE).alias("scope"), "version_hash", "version_id"), {"ignoreNullFields": "false"}), 256)


def evaluate_pack(cases: DataFrame, versions: list[Version], case: str = "case_id", version: str = "version_id", date: str = "evaluation_date") -> DataFrame:
    """``(case, version_id, code, outcome, resolved, content_hash)`` of each case under the version that it names.

    ``cases``: rows of ``evaluate.by_case`` with the version's id and the date of evaluation, a text
    that orders as time.  ``code`` is EVALUATED, VERSION_UNKNOWN, or OUTSIDE_VALIDITY where the version
    is not valid at that date (a null date is not); such cases have no outcome and no hash.
    A case stays one row, whatever the number of versions: their rules are joined by version.
    """
    known = table(cases.sparkSession, [{"version_id": v.version_id, "version_hash": v.content_hash, "valid_from": v.valid_from, "valid_to": v.valid_to} for v in versions], VERSION)
    rows = cases.select(case, F.col(version).cast("string").alias("version_id"), F.col(date).cast("string").alias("_date"), "facts", "evidence").join(known, "version_id", "left")
    valid = F.coalesce(in_interval(F.col("_date"), F.col("valid_from"), F.col("valid_to")), F.lit(False))
    rows = rows.withColumn("code", F.when(F.col("version_hash").isNull(), "VERSION_UNKNOWN").when(~valid, "OUTSIDE_VALIDITY").otherwise("EVALUATED"))
    none = rows.where("code <> 'EVALUATED'").select(case, "version_id", "code")
    found = evaluate_rules(rows.where("code = 'EVALUATED'"), {v.version_id: v.rules for v in versions}, case, "version_id", with_evidence=False, keep=["_date", "version_hash", "code"])
    done = resolve_findings(found, {v.version_id: Pack.of(v.rules, v.declared, v.norms) for v in versions}, by="version_id")
    done = done.withColumn("outcome", outcomes(F.col("resolved"), "effective"))
    done = done.select(case, "version_id", "code", "outcome", "resolved", snapshot_hash(F.col("_date")).alias("content_hash"))
    return done.unionByName(none, allowMissingColumns=True)


def evaluate_as_of(requests: DataFrame, activations: DataFrame, versions_table: DataFrame, cases: DataFrame, versions: list[Version], case: str = "case_id") -> DataFrame:
    """``(request_id, status, version_id, code, outcome, content_hash)``: the version in force for each request
    (see ``ledgers.resolve_pack``), evaluated over the request's case."""
    found = resolve_pack(activations, versions_table, requests)
    asked = found.where("status = 'FOUND'").join(requests.select("request_id", case, F.col("evaluation_date").alias("evaluation_date")), "request_id").join(cases, case)
    date = F.lpad(F.col("evaluation_date").cast("string"), 10, "0") if dict(requests.dtypes)["evaluation_date"] in ("int", "bigint") else F.col("evaluation_date")
    done = evaluate_pack(asked.withColumn("evaluation_date", date), versions, "request_id")
    return found.select("request_id", "status", F.col("version_id").cast("string").alias("version_id")).join(done.drop("version_id", "resolved"), "request_id", "left")
