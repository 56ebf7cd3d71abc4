"""Append-only ledgers: states, as-of selection, intervals, chains and their checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import in_interval
from .folds import BLOCK, BLOCKS, ordered_fold, overlapping_pairs


def latest_state(events: DataFrame, key: str = "version_id", state: str = "to_state", order: str = "sequence") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, order).alias("state"))


def state_as_of(events: DataFrame, requests: DataFrame, key: str, at: str, moment: str, order: list[str], values: list[str]) -> DataFrame:
    """For each request the values of the last event of its key at or before its moment.

    Events and requests are sorted together; an event at the moment itself counts.  Requests
    without an event keep nulls.  A key with many events is cut into blocks of time, which are sorted apart: what a
    block's requests find before their block is the last event of the nearest earlier
    block that has any.  So one key that holds all events is spread over tasks.
    """
    carried = F.struct(*values)
    e = events.select(F.col(key), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(*order).alias("_order"), carried.alias("_event"), F.lit(None).cast(requests.select(F.struct("*")).schema[0].dataType).alias("_request"))
    r = requests.select(F.col(key), F.col(moment).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(e.schema["_order"].dataType).alias("_order"), F.lit(None).cast(e.schema["_event"].dataType).alias("_event"), F.struct(*requests.columns).alias("_request"))
    every = max(BLOCK, events.count() // BLOCKS)
    cuts = e.where(F.col(key).isNotNull() & F.col("_at").isNotNull() & (F.pmod(F.xxhash64(key, "_at", "_order"), F.lit(every)) == 0)).groupBy(key).agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.lit(0))
    both = e.unionByName(r).join(cuts, key, "left").withColumn("_block", F.when(F.col("_cuts").isNull(), 0).otherwise(block)).drop("_cuts")
    w = Window.partitionBy(key, "_block").orderBy("_at", "_kind", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of keys with cuts, the last event of each block.
    ends = e.join(cuts, key).withColumn("_block", block).groupBy(key, "_block").agg(F.max_by("_event", F.struct("_at", "_order")).alias("_end"))
    ends = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_block").alias("b"), F.col("_end").alias("e")))).alias("_ends"))
    found = both.withColumn("_last", F.last("_event", ignorenulls=True).over(w)).where("_kind = 1").join(ends, key, "left")
    earlier = F.try_element_at(F.filter("_ends", lambda x: x["b"] < F.col("_block")), F.lit(-1))["e"]
    return found.withColumn("_last", F.coalesce("_last", earlier)).select("_request.*", *[F.col("_last")[v].alias(v) for v in values])


def check_chain(events: DataFrame, key: str, order: str = "sequence", content: list[str] | None = None, previous: str = "previous_hash", own: str = "content_hash") -> DataFrame:
    """``(key, sequence, code)`` of links that break: a gap, another predecessor, or content of another hash."""
    from ..functions.hashing import content_hash

    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumns({"_n": F.row_number().over(w), "_before": F.lag(own).over(w)})
    code = F.when(F.col(order) != F.col("_n"), "SEQUENCE_GAP").when(~F.col(previous).eqNullSafe(F.col("_before")), "PREVIOUS_HASH_MISMATCH")
    if content:
        code = code.when(F.col(own) != content_hash(*content), "CONTENT_HASH_MISMATCH")
    return rows.select(key, order, code.alias("code")).where("code is not null")


def validate_transitions(events: DataFrame, moves: list[tuple], key: str = "version_id") -> DataFrame:
    """``(key, sequence, code)``: sequence from 1 without gaps, the state moved from is the last one,
    times do not fall, the move is allowed for the role, and no actor acts twice.

    Where events have ``content_hash`` and ``version_hash``, the hash of what was judged must be the version's.
    """
    w = Window.partitionBy(key).orderBy("sequence", "moved_at")
    rows = events.withColumns({"_n": F.row_number().over(w), "_state": F.lag("to_state").over(w), "_at": F.lag("moved_at").over(w), "_acts": F.row_number().over(Window.partitionBy(key, "actor_id").orderBy("sequence", "moved_at"))})
    allowed = F.lit(False)
    for a, b, role in moves:
        allowed = allowed | ((F.col("from_state").isNull() if a is None else F.col("from_state").eqNullSafe(F.lit(a))) & (F.col("to_state") == b) & (F.col("role") == role))
    code = F.when(F.col("sequence") != F.col("_n"), "SEQUENCE_GAP").when(~F.col("from_state").eqNullSafe(F.col("_state")), "STATE_MISMATCH")
    if {"content_hash", "version_hash"} <= set(events.columns):
        code = code.when(~F.col("content_hash").eqNullSafe(F.col("version_hash")), "HASH_MISMATCH")
    code = code.when(F.col("moved_at") < F.col("_at"), "TIME_REVERSED").when(~allowed, "MOVE_NOT_ALLOWED").when(F.col("actor_id").isNotNull() & (F.col("_acts") > 1), "ACTOR_NOT_INDEPENDENT")
    return rows.select(key, "sequence", code.alias("code")).where("code is not null")


def resolve_pack(activations: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request the one version whose pack is active as of its date, in its scope and validity.

    ``activations``: pack_id, sequence, type, version_id, effective_at; ``versions``: version_id, domain,
    jurisdiction, valid_from, valid_to; ``requests``: request_id, domain, jurisdiction, evaluation_date.
    """
    # A null start counts from the first, as nulls sort first; a request without a date finds nothing.
    # Spans within their validity open and close at instants, so what is active at one is a running sum over a scope's
    # instants; the numbers of versions in their scope are summed too, which names the version where only one is active.
    scope = ["domain", "jurisdiction"]
    numbered = versions.withColumn("_v", F.row_number().over(Window.partitionBy(*scope).orderBy("version_id")).cast("decimal(38,0)"))
    spans = activation_spans(activations).join(numbered, "version_id")
    spans = spans.select(*scope, "_v", F.greatest("effective_at", "valid_from").alias("_s"), F.least("until", "valid_to").alias("_e")).where("_e is null or _s is null or _s < _e")
    steps = spans.select(*scope, F.col("_s").alias("_at"), F.lit(1).cast("long").alias("_n"), "_v").unionByName(spans.where("_e is not null").select(*scope, F.col("_e").alias("_at"), F.lit(-1).cast("long").alias("_n"), (-F.col("_v")).cast("decimal(38,0)").alias("_v")))
    steps = steps.groupBy(*scope, "_at").agg(F.sum("_n").alias("_n"), F.sum("_v").cast("decimal(38,0)").alias("_v"))
    asked = requests.select(*scope, F.col("evaluation_date").alias("_at")).where("_at is not null").distinct()
    w = Window.partitionBy(*scope).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = steps.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    known = both.select(*scope, "_at", "_asked", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("n"), F.sum("_v").over(w).cast("decimal(38,0)").alias("_v")).where("_asked").drop("_asked")
    known = known.join(numbered.select(*scope, "_v", "version_id"), [*scope, "_v"], "left").select(*scope, F.col("_at").alias("evaluation_date"), "n", F.when(F.col("n") == 1, F.col("version_id")).alias("version_id"))
    hit = requests.join(known, [*scope, "evaluation_date"], "left")
    got = hit.groupBy("request_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("version_id").alias("version_id"))
    return got.select("request_id", F.when(F.col("n") == 1, "FOUND").when(F.col("n") == 0, "NOT_FOUND").otherwise("AMBIGUOUS").alias("status"), F.when(F.col("n") == 1, F.col("version_id")).alias("version_id"))


def activation_spans(activations: DataFrame) -> DataFrame:
    """From each event to the next of its pack; deactivations open no span."""
    w = Window.partitionBy("pack_id").orderBy("sequence")
    return activations.withColumn("until", F.lead("effective_at").over(w)).where("type <> 'DEACTIVATE'").select("pack_id", "sequence", "version_id", "effective_at", "until")


def activation_intervals(activations: DataFrame, versions: DataFrame) -> DataFrame:
    """Spans cut to the validity of their version; empty ones are dropped."""
    rows = activation_spans(activations).join(versions.select("version_id", "valid_from", "valid_to"), "version_id")
    rows = rows.select("pack_id", "sequence", "version_id", F.greatest("effective_at", "valid_from").alias("start"), F.least("until", "valid_to").alias("end"))
    return rows.where("end is null or start < end")


def scope_overlaps(intervals: DataFrame, scope: list[str], key: str = "pack_id") -> DataFrame:
    """Pairs of different packs of one scope whose intervals overlap; see ``folds.overlapping_pairs``."""
    return overlapping_pairs(intervals, scope, key)


def card_state(audit: DataFrame, needed: Column | int = 1, key: str = "revision_id") -> DataFrame:
    """The fold of a card's audit entries: transitions set the state, a review that asks for changes
    or an approval that rejects sends it back, enough approvals approve it."""
    w = Window.partitionBy(key).orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    approvals = F.sum(F.when((F.col("kind") == "APPROVAL") & (F.col("decision") == "APPROVED"), 1).otherwise(0)).over(w)
    rows = audit.withColumn("_approvals", approvals)
    state = (
        F.when(F.col("kind") == "TRANSITION", F.col("decision")).when(F.col("decision").isin("CHANGES_REQUESTED", "REJECTED"), "CHANGES_REQUESTED")
        .when((F.col("kind") == "APPROVAL") & (F.col("decision") == "APPROVED") & (F.col("_approvals") >= (needed if isinstance(needed, Column) else F.lit(needed))), "APPROVED")
    )
    return rows.withColumn("_state", state).groupBy(key).agg(F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("sequence"))).alias("state"))


def validate_versions(versions: DataFrame, series: str = "pack_id") -> DataFrame:
    """``(series, version_id, code)``, in the order of publication: another domain or jurisdiction than the first
    version's, a publisher among the contributors, a SemVer used before or not above the last one, a time that is
    not later, or another predecessor superseded than the last version.

    ``versions``: series, version_id, semver, published_at, and, where they are to be checked, domain,
    jurisdiction, publisher with contributors (an array), and supersedes.
    """
    from ..functions.rules import semver_sort_key

    w = Window.partitionBy(series).orderBy("published_at", "version_id")
    again = F.row_number().over(Window.partitionBy(series, "semver").orderBy("published_at", "version_id"))
    rows = versions.withColumns({"_n": again, "_key": semver_sort_key(F.col("semver"))})
    rows = rows.withColumns({"_before": F.lag("_key").over(w), "_at": F.lag("published_at").over(w), "_last": F.lag("version_id").over(w)})
    code = F.when(F.lit(False), "")
    if {"domain", "jurisdiction"} <= set(versions.columns):
        scope = F.struct("domain", "jurisdiction")
        rows = rows.withColumn("_scope", F.first(scope).over(w))
        code = code.when(~F.col("_scope").eqNullSafe(scope), "SCOPE_MISMATCH")
    if {"publisher", "contributors"} <= set(versions.columns):
        code = code.when(F.coalesce(F.array_contains("contributors", F.col("publisher")), F.lit(False)), "PUBLISHER_NOT_INDEPENDENT")
    code = code.when(F.col("_n") > 1, "DUPLICATE_SEMVER").when(F.col("_key") <= F.col("_before"), "SEMVER_NOT_INCREASING").when(F.col("published_at") <= F.col("_at"), "PUBLISH_TIME_INVALID")
    if "supersedes" in versions.columns:
        code = code.when(~F.col("supersedes").eqNullSafe(F.col("_last")), "SUPERSESSION_INVALID")
    return rows.select(series, "version_id", code.alias("code")).where("code is not null")


def history(versions: DataFrame, events: DataFrame, key: str = "version_id") -> DataFrame:
    """Versions with their moves in order, as text, and their number."""
    moves = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sequence", "to_state"))).alias("m"))
    return versions.join(moves, key, "left").select(key, F.concat_ws(">", F.transform("m", lambda x: x["to_state"])).alias("moves"), F.coalesce(F.size("m"), F.lit(0)).alias("n"))


def draft_conflicts(writes: DataFrame, key: str, expected: str, order: list[str]) -> DataFrame:
    """Writes that lose: of those that expect one revision the first wins."""
    w = Window.partitionBy(key, expected).orderBy(*order)
    return writes.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def final_decision(decisions: DataFrame, key: str = "run_id") -> DataFrame:
    last = decisions.groupBy(key).agg(F.max_by(F.struct("decision", "target_outcome"), "sequence").alias("d"))
    return last.select(key, "d.decision", F.when(F.col("d.decision") != "REQUEST_MORE_EVIDENCE", F.col("d.target_outcome")).alias("target_outcome"))


def completeness(controls: DataFrame, codes: list, run: str = "run_id", code: str = "field_code") -> DataFrame:
    """``(run, missing, repeated, extra)``: every code is wanted exactly once."""
    wanted = F.array(*map(F.lit, codes))
    per = controls.groupBy(run, code).count().groupBy(run).agg(F.collect_set(code).alias("has"), F.count_if((F.col("count") > 1) & F.array_contains(wanted, F.col(code))).alias("repeated"))
    return per.select(run, F.size(F.array_except(wanted, "has")).cast("long").alias("missing"), "repeated", F.size(F.array_except("has", wanted)).cast("long").alias("extra"))


def append_idempotent(history_: DataFrame, records: DataFrame, by: list[str], order: list[str], request: str = "request_hash", at: str | None = None, expiry: float | None = None) -> DataFrame:
    """CREATED for the first record of a key, REPLAYED for the same request again, else CONFLICT.
    Records in ``history_`` come first.

    With ``expiry`` (seconds) a key may be used again once its record is that old by the timestamps
    ``at``: the next one is CREATED and takes its place.  Records without a time never expire a key,
    and such a key's record is never too old.
    """
    both = history_.withColumn("_new", F.lit(False)).unionByName(records.withColumn("_new", F.lit(True)))
    if expiry is not None:
        rows = ordered_fold(both.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))), by, ["_new", *order], [request, "_at"], functools.partial(_request, int(expiry * 1_000_000)), "status")
        return rows.where("_new").drop("_new", "_at")
    w = Window.partitionBy(*by).orderBy("_new", *order)
    rows = both.withColumns({"_n": F.row_number().over(w), "_first": F.first(request).over(w)}).where("_new")
    return rows.withColumn("status", F.when(F.col("_n") == 1, "CREATED").when(F.col(request) == F.col("_first"), "REPLAYED").otherwise("CONFLICT")).drop("_n", "_first", "_new")


def _request(expiry: int, state: tuple | None, request: str | None, at: int | None) -> tuple[tuple, str]:
    if state is None or (at is not None and state[1] is not None and at - state[1] >= expiry):
        return (request, at), "CREATED"
    return state, "REPLAYED" if request is not None and request == state[0] else "CONFLICT"


def upsert(existing: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Rows of both, the new one winning for a key; of several new ones the one of the greatest ``written``."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*by).orderBy(F.desc("_new"), F.desc("written"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def append_decisions(ledger: DataFrame, new: DataFrame, runs: DataFrame, run: str = "run_id", order: list[str] | None = None, decision: str | None = None) -> DataFrame:
    """Adds ``status`` to new decisions: ACCEPTED, or why not.

    Decisions of a run are taken in ``order`` (else by sequence); each accepted one is what the next
    must follow, and a rejected one leaves the run as it was.  With ``decision``, the column of
    a decision's id, an id that the ledger has, or that an earlier new decision of the run was accepted under,
    ALREADY_EXISTS.
    """
    last = ledger.groupBy(run).agg(F.max("sequence").alias("_last"), F.max_by("content_hash", "sequence").alias("_hash"))
    rows = new.join(runs.select(run, F.col("run_hash").alias("_run_hash")), run, "left").join(last, run, "left")
    own = ["content_hash"] if "content_hash" in new.columns else []
    known = [decision] if decision else []
    if decision:
        rows = rows.join(ledger.select(decision).distinct().withColumn("_known", F.lit(True)), decision, "left")
    else:
        rows = rows.withColumn("_known", F.lit(False))
    reads = ["run_hash", "_run_hash", "_known", "sequence", "previous_hash", "_last", "_hash", *known, *own]
    rows = ordered_fold(rows, [run], order or ["sequence"], reads, functools.partial(_decision, bool(known), bool(own)), "status")
    return rows.drop("_run_hash", "_last", "_hash", "_known")


def _decision(known: bool, own: bool, state: tuple | None, run_hash, expected, exists, sequence, previous, last, digest, *more) -> tuple[tuple, str]:
    last, digest, taken = state or (last or 0, digest, frozenset())
    code = (
        "RUN_NOT_FOUND" if expected is None else "RUN_HASH_MISMATCH" if run_hash != expected else "ALREADY_EXISTS" if exists or (known and more[0] in taken)
        else "SEQUENCE_MISMATCH" if sequence != last + 1 else "PREVIOUS_HASH_MISMATCH" if previous != digest else "ACCEPTED"
    )
    if code == "ACCEPTED":
        last, digest = sequence, more[-1] if own else None
        taken = taken | {more[0]} if known else taken
    return (last, digest, taken), code


def review_queue(findings: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """Each finding PENDING or REVIEWED, by its last decision; ``rationale_missing`` where a critical
    finding was not confirmed and no reason is given."""
    last = decisions.groupBy(*by).agg(F.max_by(F.struct("decision", "rationale"), "sequence").alias("d"))
    rows = findings.join(last, by, "left")
    return rows.select(*findings.columns, F.when(F.col("d").isNull(), "PENDING").otherwise("REVIEWED").alias("status"), F.coalesce((F.col("risk") == "CRITICAL") & (F.col("d.decision") != "CONFIRM") & (F.coalesce(F.trim("d.rationale"), F.lit("")) == ""), F.lit(False)).alias("rationale_missing"))


def exportable(queue: DataFrame, *by: str) -> DataFrame:
    """``(*by, exportable)``: whether all findings of a queue are reviewed and none lacks its rationale."""
    return queue.groupBy(*by).agg(F.bool_and((F.col("status") == "REVIEWED") & ~F.col("rationale_missing")).alias("exportable"))


def claimable_jobs(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """REPLAY for claims of finished jobs, CLAIMED for the first claim on the expected version, else LOST."""
    w = Window.partitionBy("job_id", "expected_version").orderBy("at", "claim_id")
    rows = claims.withColumn("_n", F.row_number().over(w)).join(jobs, "job_id")
    return rows.select("claim_id", "job_id", F.when(F.col("job_status").isin("SUCCEEDED", "FAILED"), "REPLAY").when((F.col("expected_version") == F.col("version")) & (F.col("_n") == 1), "CLAIMED").otherwise("LOST").alias("status"))


def run_source_consistency(runs: DataFrame, packs: DataFrame) -> DataFrame:
    """``(run_id, code)`` where a run's pack is missing or its source hash is another."""
    rows = runs.join(packs.select("pack_id", F.col("source_hash").alias("_pack_hash")), "pack_id", "left")
    code = F.when(F.col("_pack_hash").isNull(), "PACK_MISSING").when(F.col("source_hash") != F.col("_pack_hash"), "SOURCE_HASH_MISMATCH")
    return rows.select("run_id", code.alias("code")).where("code is not null")
