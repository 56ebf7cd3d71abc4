"""Queries of ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import SOURCE_MOVES
from ..operators import ledgers
from .registry import query

STATES = "CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'view' THEN 'REVIEWED' WHEN 'purchase' THEN 'APPROVED' WHEN 'click' THEN 'RETIRED' ELSE 'UPLOADED' END"
#: Moves by user; sequences have gaps where the event id is divisible by 17.
MOVES = f"""SELECT user_id AS version_id, n + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS sequence, lag(s) OVER (PARTITION BY user_id ORDER BY n) AS from_state, s AS to_state, event_id % 5 AS actor_id,
 CASE event_id % 3 WHEN 0 THEN 'AUTHOR' WHEN 1 THEN 'REVIEWER' ELSE 'APPROVER' END AS role, n * 10 - CASE WHEN event_id % 19 = 0 THEN 15 ELSE 0 END AS moved_at FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n, {STATES} AS s FROM events) q"""
#: Activations by user: numbered, with a version of the nation table.
ACTIVATIONS = """SELECT user_id AS pack_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence, CASE event_type WHEN 'signup' THEN 'ACTIVATE' WHEN 'purchase' THEN 'ROLLBACK' ELSE 'DEACTIVATE' END AS type, event_id % 25 AS version_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) * 10 + user_id % 7 AS effective_at FROM events WHERE event_type IN ('signup', 'purchase', 'error')"""
VERSIONS = """SELECT n_nationkey AS version_id, r_name AS domain, n_name AS jurisdiction, CAST(n_nationkey % 4 * 10 AS INT) AS valid_from, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey % 4 * 10 + 60 AS INT) END AS valid_to FROM nation JOIN region ON n_regionkey = r_regionkey"""
REQUESTS = """SELECT c_custkey AS request_id, r_name AS domain, n_name AS jurisdiction, CAST(c_custkey % 50 AS INT) AS evaluation_date FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CHAIN = """SELECT user_id AS run_id, sequence, CASE WHEN event_id % 29 = 0 THEN 'broken' ELSE lag(h) OVER (PARTITION BY user_id ORDER BY sequence) END AS previous_hash, h AS content_hash, event_id, event_type FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence, sha2(concat('{"event_id":', CAST(event_id AS STRING), ',"event_type":"', event_type, '"}'), 256) AS h FROM events) q"""
CHAIN_SQL = CHAIN.replace("sha2(", "sha256(").replace(", 256)", ")")


@query("lg1_latest_state", f"SELECT version_id, max_by(to_state, sequence * 100 + length(to_state)) AS state FROM (SELECT * FROM ({MOVES}) QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY sequence DESC, moved_at DESC) = 1) GROUP BY version_id")
def lg1(t):
    return ledgers.latest_state(t.sql(MOVES).withColumn("order", F.struct("sequence", "moved_at")), order="order")


@query("lg2_state_as_of", f"""SELECT request_id, version_id, moment, arg_max(to_state, struct_pack(a := moved_at, b := sequence)) AS to_state FROM (SELECT e.user_id AS version_id, e.event_id AS request_id, CAST(e.event_id % 200 AS INT) AS moment FROM events e) r LEFT JOIN ({MOVES}) m USING (version_id) WHERE m.moved_at <= moment GROUP BY ALL
UNION ALL SELECT e.event_id, e.user_id, CAST(e.event_id % 200 AS INT), NULL FROM events e WHERE NOT EXISTS (SELECT 1 FROM ({MOVES}) m WHERE m.version_id = e.user_id AND m.moved_at <= e.event_id % 200)""")
def lg2(t):
    r = t.events.select("event_id", "user_id").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("version_id"), (F.col("event_id") % 200).cast("int").alias("moment"))
    return ledgers.state_as_of(t.sql(MOVES), r, "version_id", "moved_at", "moment", ["sequence"], ["to_state"]).select("request_id", "version_id", "moment", "to_state")


ALLOWED = "((from_state IS NULL AND to_state = 'UPLOADED' AND role = 'AUTHOR') OR (from_state = 'UPLOADED' AND to_state = 'REVIEWED' AND role = 'REVIEWER') OR (from_state = 'REVIEWED' AND to_state = 'APPROVED' AND role = 'APPROVER') OR (from_state = 'APPROVED' AND to_state = 'RETIRED' AND role = 'APPROVER'))"


@query("lg3_validate_transitions", f"""SELECT version_id, sequence, code FROM (SELECT version_id, sequence, CASE WHEN sequence <> n THEN 'SEQUENCE_GAP' WHEN from_state IS DISTINCT FROM before THEN 'STATE_MISMATCH' WHEN hash_ok = 0 THEN 'HASH_MISMATCH' WHEN moved_at < at_before THEN 'TIME_REVERSED' WHEN NOT coalesce({ALLOWED}, false) THEN 'MOVE_NOT_ALLOWED' WHEN seen > 0 THEN 'ACTOR_NOT_INDEPENDENT' END AS code
 FROM (SELECT *, CASE WHEN (version_id + sequence) % 23 = 0 THEN 0 ELSE 1 END AS hash_ok, row_number() OVER w AS n, lag(to_state) OVER w AS before, lag(moved_at) OVER w AS at_before, count(*) OVER (PARTITION BY version_id, actor_id ORDER BY sequence, moved_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({MOVES}) WINDOW w AS (PARTITION BY version_id ORDER BY sequence, moved_at))) WHERE code IS NOT NULL""")
def lg3(t):
    hash_ = F.sha2(F.col("version_id").cast("string"), 256)
    moves = t.sql(MOVES).withColumns({"version_hash": hash_, "content_hash": F.when((F.col("version_id") + F.col("sequence")) % 23 == 0, "other").otherwise(hash_)})
    return ledgers.validate_transitions(moves, SOURCE_MOVES)


@query("lg5_resolve_pack", f"""WITH s AS (SELECT * FROM (SELECT *, lead(effective_at) OVER (PARTITION BY pack_id ORDER BY sequence) AS until FROM ({ACTIVATIONS})) WHERE type <> 'DEACTIVATE'), h AS (SELECT r.request_id, s.version_id FROM ({REQUESTS}) r JOIN ({VERSIONS}) v USING (domain, jurisdiction) JOIN s USING (version_id) WHERE effective_at <= evaluation_date AND (until IS NULL OR evaluation_date < until) AND valid_from <= evaluation_date AND (valid_to IS NULL OR evaluation_date < valid_to))
SELECT request_id, CASE count(h.version_id) WHEN 1 THEN 'FOUND' WHEN 0 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN count(h.version_id) = 1 THEN max(h.version_id) END AS version_id FROM ({REQUESTS}) r LEFT JOIN h USING (request_id) GROUP BY request_id""")
def lg5(t):
    return ledgers.resolve_pack(t.sql(ACTIVATIONS), t.sql(VERSIONS), t.sql(REQUESTS))


INTERVALS = f"SELECT * FROM (SELECT pack_id, sequence, version_id, greatest(effective_at, valid_from) AS start, CASE WHEN until IS NULL THEN valid_to WHEN valid_to IS NULL THEN until ELSE least(until, valid_to) END AS end_ FROM (SELECT *, lead(effective_at) OVER (PARTITION BY pack_id ORDER BY sequence) AS until FROM ({ACTIVATIONS})) JOIN ({VERSIONS}) USING (version_id) WHERE type <> 'DEACTIVATE') WHERE end_ IS NULL OR start < end_"


@query("lg6_activation_intervals", f"SELECT pack_id, sequence, version_id, start, end_ AS \"end\" FROM ({INTERVALS})")
def lg6(t):
    return ledgers.activation_intervals(t.sql(ACTIVATIONS), t.sql(VERSIONS))


@query("lg7_scope_overlaps", f"SELECT DISTINCT a.version_id, a.pack_id AS pack_id_a, b.pack_id AS pack_id_b FROM ({INTERVALS}) a JOIN ({INTERVALS}) b USING (version_id) WHERE a.pack_id < b.pack_id AND (a.end_ IS NULL OR b.start < a.end_) AND (b.end_ IS NULL OR a.start < b.end_)")
def lg7(t):
    return ledgers.scope_overlaps(ledgers.activation_intervals(t.sql(ACTIVATIONS), t.sql(VERSIONS)), ["version_id"])


AUDIT = "SELECT conv_id AS revision_id, turn AS sequence, CASE role WHEN 'user' THEN 'TRANSITION' WHEN 'assistant' THEN 'APPROVAL' ELSE 'REVIEW' END AS kind, CASE WHEN role = 'user' THEN CASE WHEN turn % 2 = 0 THEN 'DRAFT' ELSE 'IN_REVIEW' END WHEN conv_id % 5 = 0 THEN 'REJECTED' WHEN conv_id % 7 = 0 THEN 'CHANGES_REQUESTED' ELSE 'APPROVED' END AS decision FROM conversations"


@query("lg8_card_state", f"""SELECT revision_id, max_by(s, o) FILTER (s IS NOT NULL) AS state FROM (SELECT revision_id, (sequence) AS o, CASE WHEN kind = 'TRANSITION' THEN decision WHEN decision IN ('CHANGES_REQUESTED', 'REJECTED') THEN 'CHANGES_REQUESTED' WHEN kind = 'APPROVAL' AND sum(CASE WHEN kind = 'APPROVAL' AND decision = 'APPROVED' THEN 1 ELSE 0 END) OVER (PARTITION BY revision_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) >= 2 THEN 'APPROVED' END AS s FROM (SELECT DISTINCT * FROM ({AUDIT}) QUALIFY row_number() OVER (PARTITION BY revision_id, sequence ORDER BY kind, decision) = 1)) GROUP BY revision_id""")
def lg8(t):
    rows = t.sql(AUDIT).groupBy("revision_id", "sequence").agg(F.min(F.struct("kind", "decision")).alias("x")).select("revision_id", "sequence", "x.*")
    return ledgers.card_state(rows, 2)


#: Versions by user; some are published together, in another scope, by a contributor, or supersede the wrong one.
SERIES = """SELECT user_id AS pack_id, event_id AS version_id, event_id % 40 AS v, n - CASE WHEN event_id % 9 = 4 THEN 1 ELSE 0 END AS published_at, CASE WHEN event_id % 37 = 1 THEN 'other' ELSE 'demo' END AS domain, 'XX' AS jurisdiction,
 event_id % 6 AS publisher, event_id % 11 AS contributor, CASE WHEN event_id % 5 = 2 THEN -1 ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY n) END AS supersedes FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n FROM events) q"""


@query("lg13_validate_versions", f"""SELECT pack_id, version_id, code FROM (SELECT pack_id, version_id, CASE WHEN domain <> first_domain THEN 'SCOPE_MISMATCH' WHEN publisher = contributor THEN 'PUBLISHER_NOT_INDEPENDENT' WHEN used > 1 THEN 'DUPLICATE_SEMVER' WHEN v <= before THEN 'SEMVER_NOT_INCREASING' WHEN published_at = at_before THEN 'PUBLISH_TIME_INVALID' WHEN supersedes IS DISTINCT FROM last THEN 'SUPERSESSION_INVALID' END AS code
FROM (SELECT *, row_number() OVER (PARTITION BY pack_id, v ORDER BY published_at, version_id) AS used, first(domain) OVER w AS first_domain, lag(v) OVER w AS before, lag(published_at) OVER w AS at_before, lag(version_id) OVER w AS last FROM ({SERIES}) WINDOW w AS (PARTITION BY pack_id ORDER BY published_at, version_id))) WHERE code IS NOT NULL""")
def lg13(t):
    v = t.sql(SERIES).withColumns({"semver": F.concat(F.lit("1."), F.col("v").cast("string"), F.lit(".0")), "contributors": F.array("contributor")})
    return ledgers.validate_versions(v)


@query("lg14_verify_hash_chain", f"SELECT run_id, sequence, 'PREVIOUS_HASH_MISMATCH' AS code FROM ({CHAIN_SQL}) WHERE previous_hash = 'broken'")
def lg14(t):
    return ledgers.check_chain(t.sql(CHAIN), "run_id", content=["event_id", "event_type"])


@query("lg15_source_history", f"SELECT c_custkey AS version_id, coalesce(m, '') AS moves, CAST(coalesce(n, 0) AS INTEGER) AS n FROM customer LEFT JOIN (SELECT version_id, string_agg(to_state, '>' ORDER BY sequence, to_state) AS m, count(*) AS n FROM ({MOVES}) GROUP BY version_id) ON version_id = c_custkey")
def lg15(t):
    return ledgers.history(t.customer.select(F.col("c_custkey").alias("version_id")), t.sql(MOVES))


@query("lg16_draft_conflicts", "SELECT event_id, user_id, event_id % 4 AS expected FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) > 1")
def lg16(t):
    w = t.events.select("event_id", "user_id", "ts", (F.col("event_id") % 4).alias("expected"))
    return ledgers.draft_conflicts(w, "user_id", "expected", ["ts", "event_id"]).drop("ts")


@query("au4_final_decision", "SELECT user_id AS run_id, max_by(d, n) AS decision, CASE WHEN max_by(d, n) <> 'REQUEST_MORE_EVIDENCE' THEN max_by(o, n) END AS target_outcome FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'error' THEN 'REQUEST_MORE_EVIDENCE' WHEN 'view' THEN 'CONFIRM' ELSE 'OVERRIDE' END AS d, CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS o FROM events) GROUP BY user_id")
def au4(t):
    d = t.sql("SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, CASE event_type WHEN 'error' THEN 'REQUEST_MORE_EVIDENCE' WHEN 'view' THEN 'CONFIRM' ELSE 'OVERRIDE' END AS decision, CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS target_outcome FROM events")
    return ledgers.final_decision(d)


@query("au6_label_completeness", "SELECT l_orderkey AS run_id, 7 - count(DISTINCT l_linenumber) AS missing, count(DISTINCT l_linenumber) FILTER (c > 1) AS repeated, CAST(0 AS BIGINT) AS extra FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def au6(t):
    return ledgers.completeness(t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("int").alias("field_code")), list(range(1, 8)))


@query("snk2_append_idempotent", "SELECT event_id, CASE WHEN n = 1 THEN 'CREATED' WHEN event_type = f THEN 'REPLAYED' ELSE 'CONFLICT' END AS status FROM (SELECT event_id, event_type, row_number() OVER w AS n, first(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id % 4 > 0, ts, event_id)) WHERE event_id % 4 > 0")
def snk2(t):
    r = t.events.select("event_id", F.col("user_id").alias("scope"), F.get_json_object("props", "$.k").alias("key"), F.sha2("event_type", 256).alias("request_hash"), "ts")
    stored = F.col("event_id") % 4 == 0
    return ledgers.append_idempotent(r.where(stored), r.where(~stored), ["scope", "key"], ["ts", "event_id"]).select("event_id", "status")


@query("snk1_upsert_chunks", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS content, CASE WHEN doc_id % 3 = 0 THEN 20 ELSE 1 END AS written FROM documents UNION ALL SELECT doc_id + 1000000000, 'new', 20 FROM documents WHERE doc_id % 3 = 0")
def snk1(t):
    old = t.documents.select("doc_id", F.lit("old").alias("content"), F.lit(1).alias("written"))
    third = t.documents.where("doc_id % 3 = 0")
    new = third.select("doc_id", F.explode(F.array(F.struct(F.lit("mid").alias("content"), F.lit(10).alias("written")), F.struct(F.lit("new").alias("content"), F.lit(20).alias("written")))).alias("x")).select("doc_id", "x.*")
    return ledgers.upsert(old, new.unionByName(new.withColumn("doc_id", F.col("doc_id") + 1_000_000_000)), ["doc_id"])


@query("snk3_append_decisions", f"SELECT user_id AS run_id, CASE WHEN user_id % 7 = 0 THEN 'RUN_NOT_FOUND' WHEN user_id % 5 = 0 THEN 'RUN_HASH_MISMATCH' WHEN user_id % 3 = 0 THEN 'SEQUENCE_MISMATCH' WHEN user_id % 2 = 0 THEN 'PREVIOUS_HASH_MISMATCH' ELSE 'ACCEPTED' END AS status FROM (SELECT DISTINCT user_id FROM events)")
def snk3(t):
    ledger = t.sql(CHAIN)
    last = ledger.groupBy("run_id").agg(F.max("sequence").alias("n"), F.max_by("content_hash", "sequence").alias("h"))
    u = F.col("run_id")
    new = last.select("run_id", F.when(u % 5 == 0, "other").otherwise("hash").alias("run_hash"), F.when(u % 3 == 0, F.col("n")).otherwise(F.col("n") + 1).alias("sequence"), F.when(u % 2 == 0, F.lit("x")).otherwise(F.col("h")).alias("previous_hash"))
    runs = last.where("run_id % 7 <> 0").select("run_id", F.lit("hash").alias("run_hash"))
    return ledgers.append_decisions(ledger, new, runs).select("run_id", "status")


#: Decisions of each user's run: one in twelve is stale, one in thirteen follows another hash, and the others follow each
#: other, so that many of a run are accepted in one batch; the first four good ones are in the ledger already.
_GOOD = "event_id % 12 <> 0 AND event_id % 13 <> 0"
DECISIONS = f"""SELECT run_id, event_id, n, CAST(CASE WHEN event_id % 12 = 0 THEN good WHEN event_id % 13 = 0 THEN good + 1 ELSE good END AS INT) AS sequence, CASE WHEN {_GOOD} THEN concat('h', CAST(run_id AS STRING), '-', CAST(good AS STRING)) ELSE concat('b', CAST(event_id AS STRING)) END AS content_hash,
 CASE WHEN event_id % 13 = 0 AND event_id % 12 <> 0 THEN 'x' WHEN good > 1 THEN concat('h', CAST(run_id AS STRING), '-', CAST(good - 1 AS STRING)) END AS previous_hash, CASE WHEN run_id % 9 = 0 THEN 'other' ELSE 'hash' END AS run_hash, CASE WHEN event_id % 17 = 0 AND {_GOOD} AND good > 4 THEN 'd0' ELSE concat('d', CAST(event_id AS STRING)) END AS decision_id, {_GOOD} AND good <= 4 AS stored FROM (
SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(sum(CASE WHEN {_GOOD} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS good FROM events) q"""


@query("snk3_decision_batches", f"""WITH RECURSIVE d AS ({DECISIONS}), led AS (SELECT run_id, max(sequence) AS l, max_by(content_hash, sequence) AS h FROM d WHERE stored GROUP BY run_id), nw AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n) AS i, decision_id IN (SELECT decision_id FROM d WHERE stored) AS known FROM d WHERE NOT stored),
f AS (SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(coalesce(l, 0) AS INTEGER) AS l, h, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS event_id, '' AS status FROM (SELECT DISTINCT run_id FROM nw) LEFT JOIN led USING (run_id) UNION ALL
 SELECT run_id, i, CASE WHEN status = 'ACCEPTED' THEN sequence ELSE l END, CASE WHEN status = 'ACCEPTED' THEN content_hash ELSE h END, CASE WHEN status = 'ACCEPTED' THEN list_append(taken, decision_id) ELSE taken END, event_id, status FROM (SELECT nw.*, f.l, f.h, f.taken, CASE WHEN nw.run_id % 7 = 0 THEN 'RUN_NOT_FOUND' WHEN run_hash <> 'hash' THEN 'RUN_HASH_MISMATCH' WHEN known OR list_contains(taken, decision_id) THEN 'ALREADY_EXISTS' WHEN sequence <> f.l + 1 THEN 'SEQUENCE_MISMATCH' WHEN previous_hash IS DISTINCT FROM f.h THEN 'PREVIOUS_HASH_MISMATCH' ELSE 'ACCEPTED' END AS status FROM f JOIN nw ON nw.run_id = f.run_id AND nw.i = f.i + 1))
SELECT event_id, status FROM f WHERE event_id IS NOT NULL""")
def snk3_batches(t):
    d = t.sql(DECISIONS)
    runs = d.where("run_id % 7 <> 0").select("run_id", F.lit("hash").alias("run_hash")).distinct()
    return ledgers.append_decisions(d.where("stored"), d.where("not stored").drop("stored"), runs, order=["n"], decision="decision_id").select("event_id", "status")


@query("snk2_expiring_keys", """WITH RECURSIVE r AS (SELECT event_id, user_id, coalesce(json_extract_string(props, '$.k'), '') AS k, event_type, epoch_us(ts) AS moment, event_id % 4 = 0 AS stored, row_number() OVER (PARTITION BY user_id, coalesce(json_extract_string(props, '$.k'), '') ORDER BY event_id % 4 > 0, ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, k, i, event_type AS held, moment AS since, 'CREATED' AS status, stored FROM r WHERE i = 1 UNION ALL
 SELECT r.event_id, r.user_id, r.k, r.i, CASE WHEN r.moment - since >= 259200000000 THEN event_type ELSE held END, CASE WHEN r.moment - since >= 259200000000 THEN r.moment ELSE since END, CASE WHEN r.moment - since >= 259200000000 THEN 'CREATED' WHEN event_type = held THEN 'REPLAYED' ELSE 'CONFLICT' END, r.stored FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k AND r.i = f.i + 1)
SELECT event_id, status FROM f WHERE NOT stored""")
def snk2_expiring(t):
    r = t.events.select("event_id", F.col("user_id").alias("scope"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("key"), F.sha2("event_type", 256).alias("request_hash"), "ts")
    stored = F.col("event_id") % 4 == 0
    return ledgers.append_idempotent(r.where(stored), r.where(~stored), ["scope", "key"], ["ts", "event_id"], at="ts", expiry=3 * 86_400).select("event_id", "status")


#: Intervals of users' events in the scope of an event type, for as long as the type of user says; some are open.
USER_SPANS = "SELECT event_type AS scope, user_id AS pack_id, ts AS start, CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts + (event_id % 50) * INTERVAL '1' MINUTE END AS {end} FROM events"


@query("lg7_span_overlaps", f"SELECT DISTINCT a.scope, a.pack_id AS pack_id_a, b.pack_id AS pack_id_b FROM ({USER_SPANS.format(end='e')}) a JOIN ({USER_SPANS.format(end='e')}) b USING (scope) WHERE a.pack_id < b.pack_id AND (a.e IS NULL OR a.start < a.e) AND (b.e IS NULL OR b.start < b.e) AND (a.e IS NULL OR b.start < a.e) AND (b.e IS NULL OR a.start < b.e)")
def lg7_spans(t):
    return ledgers.scope_overlaps(t.sql(USER_SPANS.format(end="end")), ["scope"])


@query("au5_review_queue", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CRITICAL' ELSE 'LOW' END AS risk, CASE WHEN o_orderkey % 4 = 0 THEN 'PENDING' ELSE 'REVIEWED' END AS status, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS rationale_missing FROM orders")
def au5(t):
    return reviews(t)


def reviews(t):
    k = F.col("o_orderkey")
    f = t.orders.select("o_orderkey", F.when(k % 3 == 0, "CRITICAL").otherwise("LOW").alias("risk"))
    d = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", F.lit(2).alias("sequence"), F.when(k % 5 == 0, "CONFIRM").otherwise("OVERRIDE").alias("decision"), F.when(k % 2 == 0, " ").otherwise("why").alias("rationale"))
    return ledgers.review_queue(f, d.unionByName(d.withColumns({"sequence": F.lit(1), "decision": F.lit("CONFIRM")})), ["o_orderkey"])


@query("au5_exportable", "SELECT o_custkey, bool_and(o_orderkey % 4 <> 0 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0)) AS exportable FROM orders GROUP BY o_custkey")
def au5_exportable(t):
    return ledgers.exportable(reviews(t).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey"), "o_custkey")


@query("au7_claimable_jobs", "SELECT event_id AS claim_id, user_id AS job_id, CASE WHEN user_id % 4 = 0 THEN 'REPLAY' WHEN event_id % 3 = user_id % 3 AND n = 1 THEN 'CLAIMED' ELSE 'LOST' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS n FROM events)")
def au7(t):
    claims = t.events.select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("expected_version"), F.col("ts").alias("at"))
    jobs = claims.select("job_id").distinct().select("job_id", (F.col("job_id") % 3).alias("version"), F.when(F.col("job_id") % 4 == 0, "SUCCEEDED").otherwise("QUEUED").alias("job_status"))
    return ledgers.claimable_jobs(jobs, claims)


@query("au8_run_source_consistency", "SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 11 = 0 THEN 'PACK_MISSING' ELSE 'SOURCE_HASH_MISMATCH' END AS code FROM orders WHERE o_custkey % 11 = 0 OR o_orderkey % 6 = 0")
def au8(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("pack_id"), F.when(F.col("o_orderkey") % 6 == 0, "bad").otherwise("good").alias("source_hash"))
    return ledgers.run_source_consistency(runs, runs.where("pack_id % 11 <> 0").select("pack_id", F.lit("good").alias("source_hash")).distinct())
