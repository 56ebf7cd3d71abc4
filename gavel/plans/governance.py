"""Queries of ledger checks and eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, governance, packs
from . import demo_rules as demo
from .cases import ALL_LINKS, ENTRY_RULES, RANKED, _conflicts_sql, cases, judged, snapshot_sql
from .fixtures import _LINES
from .ledgers import ACTIVATIONS, REQUESTS, VERSIONS
from .registry import query

#: Versions of a source by customer, with wrong revisions, predecessors and reasons.
SERIES = """SELECT o_custkey AS source_id, o_orderkey AS version_id, CAST(n + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS INT) AS revision, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey ELSE before END AS replaces_version_id,
 CASE WHEN o_orderkey % 19 = 0 THEN 'why' WHEN before IS NOT NULL THEN 'newer' END AS replacement_reason FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) q"""


@query("lg17_validate_source_versions", f"""SELECT source_id, version_id, CASE WHEN bad THEN 'INVALID_VERSION_PAYLOAD' WHEN revision <> n THEN 'REVISION_NOT_MONOTONIC' ELSE 'INVALID_REPLACEMENT' END AS code FROM
 (SELECT *, coalesce(version_id = replaces_version_id, false) OR (replaces_version_id IS NULL AND replacement_reason IS NOT NULL) OR (replaces_version_id IS NOT NULL AND replacement_reason IS NULL) AS bad, row_number() OVER w AS n, lag(version_id) OVER w AS before FROM ({SERIES}) WINDOW w AS (PARTITION BY source_id ORDER BY revision, version_id)) WHERE bad OR revision <> n OR replaces_version_id IS DISTINCT FROM before""")
def lg17(t):
    return governance.validate_source_versions(t.sql(SERIES))


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'ACTIVATE' WHEN event_id % 5 = 0 THEN 'ROLLBACK' WHEN event_id % 7 = 0 THEN 'DEACTIVATE' ELSE 'ACTIVATE' END AS type FROM events) q"
_TARGETED = f"(SELECT *, CASE type WHEN 'ROLLBACK' THEN lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY n) WHEN 'ACTIVATE' THEN event_id END AS target FROM {_NUMBERED}) q2"
#: Activation events by user, of which a few break each rule.
LEDGER = f"""SELECT user_id AS pack_id, CAST(n + CASE WHEN event_id % 61 = 0 THEN 1 ELSE 0 END AS INT) AS sequence, type, target AS version_id, CASE WHEN event_id % 67 = 0 THEN 'x' WHEN target IS NOT NULL THEN concat('v', CAST(target AS STRING)) END AS version_hash,
 CASE WHEN event_id % 53 = 0 THEN CAST(-1 AS BIGINT) ELSE lag(target) OVER (PARTITION BY user_id ORDER BY n) END AS expected_version_id, CASE WHEN event_id % 47 = 0 THEN 'bad' ELSE lag(concat('h', CAST(event_id AS STRING))) OVER (PARTITION BY user_id ORDER BY n) END AS previous_hash, concat('h', CAST(event_id AS STRING)) AS content_hash,
 CAST(n * 10 - CASE WHEN event_id % 41 = 0 THEN 15 WHEN event_id % 43 = 0 THEN 10 ELSE 0 END AS INT) AS effective_at, CAST(n * 10 - CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN 16 ELSE 2 END AS INT) AS recorded_at, CASE WHEN event_id % 59 = 0 THEN 'AUTHOR' ELSE 'APPROVER' END AS role FROM {_TARGETED}"""
PACK_VERSIONS = """SELECT event_id AS version_id, user_id + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS pack_id, concat('v', CAST(event_id AS STRING)) AS content_hash, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS minor, CASE WHEN event_id % 31 = 0 THEN 'x' ELSE 'd' END AS domain, 'j' AS jurisdiction,
 0 AS valid_from, CASE WHEN event_id % 29 = 0 THEN 5 END AS valid_to, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) * 10 - CASE WHEN event_id % 37 = 0 THEN -100 ELSE 50 END AS published_at FROM events"""


@query("lg4_validate_activations", f"""WITH l AS (SELECT e.*, v.pack_id AS v_pack, v.content_hash AS v_hash, v.minor, v.domain, v.jurisdiction, v.valid_from, v.valid_to, v.published_at, v.version_id AS v_id FROM ({LEDGER}) e LEFT JOIN ({PACK_VERSIONS}) v ON v.version_id = e.version_id),
m AS (SELECT *, row_number() OVER w AS n, lag(content_hash) OVER w AS b_hash, lag(effective_at) OVER w AS b_effective, lag(recorded_at) OVER w AS b_recorded, lag(version_id) OVER w AS active, lag(minor) OVER w AS active_minor, last_value(version_id IGNORE NULLS) OVER past AS last_id, last_value(minor IGNORE NULLS) OVER past AS last_minor,
 first_value(domain IGNORE NULLS) OVER past AS first_domain FROM l WINDOW w AS (PARTITION BY pack_id ORDER BY sequence, recorded_at, content_hash), past AS (PARTITION BY pack_id ORDER BY sequence, recorded_at, content_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, EXISTS (SELECT 1 FROM m o WHERE o.pack_id = m.pack_id AND o.version_id = m.version_id AND o.n < m.n) AS seen FROM m)
SELECT pack_id, sequence, code FROM (SELECT pack_id, sequence, CASE
 WHEN (sequence = 1) <> (previous_hash IS NULL) OR (sequence = 1 AND (type <> 'ACTIVATE' OR expected_version_id IS NOT NULL)) OR recorded_at > effective_at OR role <> 'APPROVER' OR (type = 'DEACTIVATE' AND (version_id IS NOT NULL OR version_hash IS NOT NULL OR expected_version_id IS NULL)) OR (type <> 'DEACTIVATE' AND (version_id IS NULL OR version_hash IS NULL)) OR (type = 'ROLLBACK' AND (expected_version_id IS NULL OR version_id = expected_version_id)) THEN 'INVALID_ACTIVATION_PAYLOAD'
 WHEN sequence <> n OR previous_hash IS DISTINCT FROM b_hash THEN 'ACTIVATION_SEQUENCE_MISMATCH' WHEN expected_version_id IS DISTINCT FROM active THEN 'ACTIVATION_VERSION_MISMATCH' WHEN effective_at = b_effective THEN 'ACTIVATION_OVERLAP_AMBIGUOUS' WHEN effective_at < b_effective OR recorded_at < b_recorded THEN 'ACTIVATION_TIME_NOT_MONOTONIC'
 WHEN type = 'DEACTIVATE' THEN NULL WHEN v_id IS NULL OR v_pack <> pack_id OR v_hash <> version_hash OR effective_at < valid_from OR effective_at >= valid_to THEN 'ACTIVATION_VERSION_MISMATCH' WHEN recorded_at < published_at THEN 'ACTIVATION_TIME_NOT_MONOTONIC' WHEN first_domain <> domain THEN 'ACTIVATION_VERSION_MISMATCH'
 WHEN type = 'ROLLBACK' AND (NOT seen OR active IS NULL OR minor >= active_minor) THEN 'ACTIVATION_VERSION_MISMATCH' WHEN type = 'ACTIVATE' AND coalesce(active, last_id) IS NOT NULL AND (version_id = coalesce(active, last_id) OR minor <= coalesce(active_minor, last_minor)) THEN 'ACTIVATION_VERSION_MISMATCH' END AS code FROM x) WHERE code IS NOT NULL""")
def lg4(t):
    v = t.sql(PACK_VERSIONS).withColumn("semver", F.concat(F.lit("1."), F.col("minor").cast("string"), F.lit(".0")))
    return governance.validate_activation_ledger(t.sql(LEDGER), v)


#: A source for each customer, approved but for a seventh, some retired again.
SOURCES = "SELECT c_custkey AS source_version_id, concat('s', CAST(c_custkey AS STRING)) AS content_hash, CAST(c_custkey % 40 AS INT) AS valid_from, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 40 + 100 AS INT) END AS valid_to, c_mktsegment AS domain, CAST(c_nationkey AS STRING) AS jurisdiction FROM customer"
SOURCE_MOVES = "SELECT c_custkey AS source_version_id, 1 AS sequence, 'UPLOADED' AS to_state, 10 AS moved_at FROM customer UNION ALL SELECT c_custkey, 2, 'REVIEWED', 20 FROM customer UNION ALL SELECT c_custkey, 3, 'APPROVED', CAST(30 + c_custkey % 20 AS INT) FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 4, 'RETIRED', 80 FROM customer WHERE c_custkey % 9 = 0"
#: A card for each customer with a revision for each order, and audit entries by line.
REVISIONS = """SELECT o_orderkey AS revision_id, o_custkey AS card_id, o_custkey AS source_version_id, CAST(n + CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END AS INT) AS revision, CASE WHEN o_orderkey % 47 = 0 THEN CAST(-1 AS BIGINT) ELSE before END AS replaces_revision_id, CAST(o_orderkey % 6 AS INT) AS created_by,
 CASE WHEN o_orderkey % 11 = 0 THEN 15 ELSE 5 END AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS needed, concat('r', CAST(o_orderkey AS STRING)) AS content_hash, CASE WHEN o_orderkey % 23 = 0 THEN 'stale' ELSE concat('s', CAST(o_custkey AS STRING)) END AS source_hash, CAST(o_orderkey % 30 AS INT) AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 30 + 60 AS INT) END AS valid_to
 FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) q"""
CARD_AUDIT = f"""SELECT case_id AS revision_id, CAST(n + CASE WHEN l_partkey % 41 = 0 THEN 1 ELSE 0 END AS INT) AS sequence, CASE WHEN n < 3 THEN 'TRANSITION' WHEN n = 3 OR n = 6 THEN 'REVIEW' ELSE 'APPROVAL' END AS kind, CASE WHEN n = 2 THEN 'DRAFT' END AS from_state,
 CASE WHEN n = 1 THEN 'DRAFT' WHEN n = 2 THEN 'IN_REVIEW' WHEN n = 3 OR n = 6 THEN CASE WHEN CAST(l_quantity AS INT) % 4 = 0 THEN 'CHANGES_REQUESTED' ELSE 'ACCEPTED' END WHEN CAST(l_quantity AS INT) % 9 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS decision,
 CAST((case_id + CASE WHEN l_partkey % 11 = 0 THEN n WHEN n < 3 THEN 0 WHEN n = 3 THEN 1 ELSE n - 2 END) % 6 AS INT) AS actor_id, CASE WHEN l_partkey % 29 = 0 THEN 'AUTHOR' WHEN n < 3 THEN 'AUTHOR' WHEN n = 3 OR n = 6 THEN 'REVIEWER' ELSE 'APPROVER' END AS role, CAST(n * 10 - CASE WHEN l_partkey % 37 = 0 THEN 15 ELSE 0 END AS INT) AS acted_at FROM {_LINES} q"""
_SETS = "CASE WHEN kind = 'TRANSITION' THEN decision WHEN decision IN ('CHANGES_REQUESTED', 'REJECTED') THEN 'CHANGES_REQUESTED' WHEN kind = 'APPROVAL' AND decision = 'APPROVED' AND granted >= needed THEN 'APPROVED' END"
_AUDITED = f"""r AS ({REVISIONS}), a0 AS (SELECT a.*, r.created_by, r.created_at, r.needed, count(*) FILTER (kind = 'APPROVAL' AND decision = 'APPROVED') OVER (PARTITION BY revision_id ORDER BY sequence, acted_at, actor_id ROWS UNBOUNDED PRECEDING) AS granted FROM ({CARD_AUDIT}) a JOIN r USING (revision_id)), a AS (SELECT *, {_SETS} AS sets, row_number() OVER (PARTITION BY revision_id ORDER BY sequence, acted_at, actor_id) AS rn FROM a0),
st AS (SELECT r.revision_id, arg_max(sets, rn) FILTER (sets IS NOT NULL) AS state, arg_max(acted_at, rn) AS audited, count(*) FILTER (kind = 'REVIEW' AND decision = 'ACCEPTED') AS accepted, count(*) FILTER (kind = 'APPROVAL' AND decision = 'APPROVED') AS granted, min(acted_at) FILTER (kind = 'APPROVAL' AND decision = 'APPROVED' AND a.granted = a.needed) AS quorum_at FROM r LEFT JOIN a USING (revision_id) GROUP BY r.revision_id)"""


@query("lg9_validate_card_ledger", f"""WITH {_AUDITED}, w AS (SELECT *, row_number() OVER o AS n, lag(acted_at) OVER o AS b_at, last_value(sets IGNORE NULLS) OVER past AS state, first_value(CASE WHEN kind = 'REVIEW' THEN decision END IGNORE NULLS) OVER past AS review, first_value(CASE WHEN kind = 'REVIEW' THEN actor_id END IGNORE NULLS) OVER past AS reviewer,
 count(*) FILTER (kind = 'APPROVAL') OVER (PARTITION BY revision_id, actor_id ORDER BY sequence, acted_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS twice FROM a WINDOW o AS (PARTITION BY revision_id ORDER BY sequence, acted_at, actor_id), past AS (PARTITION BY revision_id ORDER BY sequence, acted_at, actor_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT revision_id, sequence, CASE WHEN sequence <> n THEN 'AUDIT_SEQUENCE_MISMATCH' WHEN acted_at < b_at THEN 'AUDIT_TIME_NOT_MONOTONIC' WHEN kind = 'TRANSITION' THEN CASE WHEN n = 1 AND role = 'AUTHOR' AND actor_id = created_by AND from_state IS NULL AND decision = 'DRAFT' AND acted_at >= created_at THEN NULL WHEN n > 1 AND role = 'AUTHOR' AND actor_id = created_by AND state = 'DRAFT' AND from_state = 'DRAFT' AND decision = 'IN_REVIEW' THEN NULL ELSE 'RULE_CARD_TRANSITION_NOT_AUTHORIZED' END
 WHEN state IS DISTINCT FROM 'IN_REVIEW' THEN 'DECISION_NOT_ALLOWED' WHEN kind = 'REVIEW' THEN CASE WHEN role <> 'REVIEWER' OR actor_id = created_by THEN 'DECISION_NOT_AUTHORIZED' WHEN review IS NOT NULL THEN 'DUPLICATE_REVIEW_DECISION' END
 WHEN review IS DISTINCT FROM 'ACCEPTED' THEN 'REVIEW_ACCEPTANCE_REQUIRED' WHEN role <> 'APPROVER' OR actor_id = created_by OR actor_id = reviewer THEN 'DECISION_NOT_AUTHORIZED' WHEN twice > 0 THEN 'DUPLICATE_APPROVAL_DECISION' END AS code FROM w),
v AS (SELECT *, row_number() OVER c AS n, lag(revision_id) OVER c AS before, lag(state) OVER c AS b_state, lag(audited) OVER c AS b_at FROM r JOIN st USING (revision_id) WINDOW c AS (PARTITION BY card_id ORDER BY revision, revision_id)),
g AS (SELECT revision_id, CAST(NULL AS INT) AS sequence, CASE WHEN revision <> n THEN 'RULE_CARD_REVISION_NOT_MONOTONIC' WHEN replaces_revision_id IS DISTINCT FROM before THEN 'INVALID_RULE_CARD_REVISION_REPLACEMENT' WHEN before IS NOT NULL AND coalesce(b_state, '') NOT IN ('DRAFT', 'CHANGES_REQUESTED', 'APPROVED') THEN 'DECISION_NOT_ALLOWED' WHEN created_at < b_at THEN 'AUDIT_TIME_NOT_MONOTONIC' END AS code FROM v)
SELECT * FROM e WHERE code IS NOT NULL UNION ALL SELECT * FROM g WHERE code IS NOT NULL""")
def lg9(t):
    t = t.dealt(lineitem="l_orderkey")
    revisions, audit = t.sql(REVISIONS), t.sql(CARD_AUDIT)
    entries = governance.validate_card_audit(audit, revisions)
    return entries.unionByName(governance.validate_card_revisions(revisions, audit).withColumn("sequence", F.lit(None).cast("int")))


ASKED_SOURCES = "SELECT o_orderkey AS request_id, o_custkey + CASE WHEN o_orderkey % 101 = 0 THEN 1000000000 ELSE 0 END AS source_version_id, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE concat('s', CAST(o_custkey AS STRING)) END AS expected_source_hash, CAST(20 + o_orderkey % 70 AS INT) AS eligibility_at, CAST(o_orderkey % 140 AS INT) AS evaluation_date FROM orders"
_STATE_AT = "(SELECT arg_max(to_state, m.sequence) FROM moves m WHERE m.source_version_id = q.source_version_id AND m.moved_at <= q.eligibility_at)"


@query("lg10_source_eligibility", f"""WITH moves AS ({SOURCE_MOVES}), q AS ({ASKED_SOURCES}), x AS (SELECT q.*, s.content_hash, s.valid_from, s.valid_to, {_STATE_AT} AS state FROM q LEFT JOIN ({SOURCES}) s USING (source_version_id))
SELECT request_id, CASE WHEN content_hash IS NULL THEN 'VERSION_NOT_FOUND' WHEN content_hash <> expected_source_hash THEN 'CONTENT_HASH_MISMATCH' WHEN state IS DISTINCT FROM 'APPROVED' THEN 'VERSION_NOT_APPROVED' WHEN evaluation_date < valid_from OR evaluation_date >= valid_to THEN 'VERSION_OUTSIDE_VALIDITY' ELSE 'ELIGIBLE' END AS code FROM x""")
def lg10(t):
    return governance.source_eligibility(t.sql(ASKED_SOURCES), t.sql(SOURCES), t.sql(SOURCE_MOVES)).select("request_id", "code")


ASKED_CARDS = "SELECT o_orderkey AS request_id, o_orderkey + CASE WHEN o_orderkey % 103 = 0 THEN 1000000000 ELSE 0 END AS revision_id, CAST(20 + o_orderkey % 70 AS INT) AS eligibility_at, CAST(o_orderkey % 100 AS INT) AS evaluation_date, CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE concat('r', CAST(o_orderkey AS STRING)) END AS expected_revision_hash, CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE concat('s', CAST(o_custkey AS STRING)) END AS expected_source_hash, o_orderkey % 5 = 0 AS require_latest FROM orders"
_CARD_CTES = f"""WITH {_AUDITED}, moves AS ({SOURCE_MOVES}), now AS (SELECT source_version_id, arg_max(to_state, sequence) AS now_state FROM moves GROUP BY ALL), s AS (SELECT * FROM ({SOURCES}) LEFT JOIN now USING (source_version_id)), rr AS (SELECT r.*, st.state, accepted, st.granted, quorum_at, arg_max(r.revision_id, r.revision * CAST(1000000000000 AS BIGINT) + r.revision_id) OVER (PARTITION BY card_id) AS latest FROM r JOIN st USING (revision_id))"""
_CARD_CODE = """CASE WHEN r_hash IS NULL THEN 'RULE_CARD_REVISION_NOT_FOUND' WHEN require_latest AND latest <> revision_id THEN 'RULE_CARD_REVISION_SUPERSEDED' WHEN r_hash <> expected_revision_hash THEN 'RULE_CARD_CONTENT_HASH_MISMATCH' WHEN state = 'CHANGES_REQUESTED' THEN 'BLOCKING_DECISION_PRESENT' WHEN state = 'IN_REVIEW' AND accepted = 0 THEN 'REVIEW_ACCEPTANCE_REQUIRED' WHEN state = 'IN_REVIEW' AND granted < needed THEN 'APPROVAL_QUORUM_NOT_MET'
 WHEN state IS DISTINCT FROM 'APPROVED' OR quorum_at IS NULL OR eligibility_at < quorum_at THEN 'RULE_CARD_REVISION_NOT_APPROVED' WHEN s_hash IS NULL OR source_hash <> s_hash OR r_from >= s_to OR s_from >= r_to THEN 'SOURCE_VERSION_MISMATCH' WHEN now_state <> 'APPROVED' OR state_at IS DISTINCT FROM 'APPROVED' THEN 'SOURCE_VERSION_NOT_APPROVED' WHEN s_hash <> expected_source_hash THEN 'SOURCE_VERSION_MISMATCH'
 WHEN evaluation_date < r_from OR evaluation_date >= r_to OR evaluation_date < s_from OR evaluation_date >= s_to THEN 'BLOCKING_DECISION_PRESENT' ELSE 'ELIGIBLE' END"""
_CARD_ROWS = "(SELECT q0.*, rr.source_version_id, rr.content_hash AS r_hash, rr.source_hash, rr.valid_from AS r_from, rr.valid_to AS r_to, rr.needed, rr.latest, rr.state, rr.accepted, rr.granted, rr.quorum_at, s.content_hash AS s_hash, s.valid_from AS s_from, s.valid_to AS s_to, s.now_state, s.domain AS s_domain, s.jurisdiction AS s_jurisdiction FROM {0} q0 LEFT JOIN rr USING (revision_id) LEFT JOIN s ON s.source_version_id = rr.source_version_id)"


@query("lg11_card_eligibility", f"""{_CARD_CTES}, asked AS ({ASKED_CARDS}), q AS {_CARD_ROWS.format('asked')}, x AS (SELECT q.*, {_STATE_AT} AS state_at FROM q) SELECT request_id, {_CARD_CODE} AS code FROM x""")
def lg11(t):
    t = t.dealt(lineitem="l_orderkey")
    return governance.card_eligibility(t.sql(ASKED_CARDS), t.sql(REVISIONS), t.sql(CARD_AUDIT), t.sql(SOURCES), t.sql(SOURCE_MOVES)).select("request_id", "code")


#: A rule for each revision and a pack for each customer.
BOUND_RULES = "SELECT o_orderkey AS rule_id, o_custkey AS pack_id, o_custkey AS source_version_id, concat('s', CAST(o_custkey AS STRING)) AS source_hash, o_orderkey AS revision_id, CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE concat('r', CAST(o_orderkey AS STRING)) END AS revision_hash, CAST(o_orderkey % 30 AS INT) AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 30 + 60 AS INT) END AS valid_to FROM orders"
PACKS = "SELECT c_custkey AS pack_id, CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE c_mktsegment END AS domain, CAST(c_nationkey AS STRING) AS jurisdiction, 40 AS valid_from, CASE WHEN c_custkey % 13 <> 0 THEN 60 END AS valid_to, CAST(55 + c_custkey % 10 AS INT) AS eligibility_at, CASE WHEN c_custkey % 2 = 0 THEN 'PUBLICATION' ELSE 'ACTIVATION' END AS purpose FROM customer"


@query("lg12_rule_eligibility", f"""{_CARD_CTES}, asked AS (SELECT b.rule_id, b.revision_id, b.source_hash AS expected_source_hash, b.revision_hash AS expected_revision_hash, b.valid_from AS b_from, b.valid_to AS b_to, p.domain AS p_domain, p.jurisdiction AS p_jurisdiction, p.valid_from AS p_from, p.valid_to AS p_to, p.eligibility_at, p.purpose = 'PUBLICATION' AS require_latest, CASE p.purpose WHEN 'ACTIVATION' THEN p.eligibility_at ELSE b.valid_from END AS evaluation_date FROM ({BOUND_RULES}) b JOIN ({PACKS}) p USING (pack_id)),
q AS {_CARD_ROWS.format('asked')}, x AS (SELECT q.*, {_STATE_AT} AS state_at FROM q)
SELECT rule_id, CASE WHEN {_CARD_CODE} <> 'ELIGIBLE' OR rule_id % 53 = 0 OR s_hash <> expected_source_hash OR state_at <> 'APPROVED' OR evaluation_date < s_from OR evaluation_date >= s_to THEN 'RULE_PACK_RULE_NOT_ELIGIBLE' WHEN s_domain <> p_domain OR s_jurisdiction <> p_jurisdiction THEN 'RULE_PACK_SCOPE_MISMATCH'
 WHEN b_from > p_from OR (b_to IS NOT NULL AND (p_to IS NULL OR p_to > b_to)) OR s_from > p_from OR (s_to IS NOT NULL AND (p_to IS NULL OR p_to > s_to)) OR r_from > p_from OR (r_to IS NOT NULL AND (p_to IS NULL OR p_to > r_to)) THEN 'RULE_PACK_RULE_OUTSIDE_VALIDITY' ELSE 'ELIGIBLE' END AS code FROM x""")
def lg12(t):
    t = t.dealt(lineitem="l_orderkey")
    rules = t.sql(BOUND_RULES)
    return governance.rule_eligibility(rules, t.sql(PACKS), t.sql(REVISIONS), t.sql(CARD_AUDIT), t.sql(SOURCES), t.sql(SOURCE_MOVES), rules.where("rule_id % 53 = 0"))


AS_OF = "SELECT o_orderkey AS request_id, o_orderkey AS case_id, r_name AS domain, n_name AS jurisdiction, CAST(o_orderkey % 50 AS INT) AS evaluation_date FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("ev8_evaluate_as_of", demo.findings_sql() + f""", o AS (SELECT case_id, {RANKED.format('outcome')} AS outcome FROM findings WHERE rule_id < 'R7' GROUP BY case_id), sp AS (SELECT * FROM (SELECT *, lead(effective_at) OVER (PARTITION BY pack_id ORDER BY sequence) AS until FROM ({ACTIVATIONS})) WHERE type <> 'DEACTIVATE'),
h AS (SELECT q.request_id, sp.version_id FROM ({AS_OF}) q JOIN ({VERSIONS}) v USING (domain, jurisdiction) JOIN sp USING (version_id) WHERE effective_at <= evaluation_date AND (until IS NULL OR evaluation_date < until) AND valid_from <= evaluation_date AND (valid_to IS NULL OR evaluation_date < valid_to)),
g AS (SELECT q.request_id, q.case_id, count(h.version_id) AS n, max(h.version_id) AS version_id FROM ({AS_OF}) q LEFT JOIN h USING (request_id) GROUP BY ALL)
SELECT request_id, CASE n WHEN 1 THEN 'FOUND' WHEN 0 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN version_id END AS version_id, CASE WHEN n = 1 THEN outcome END AS outcome FROM g LEFT JOIN o USING (case_id)""")
def ev8(t):
    outcomes = judged(t, ENTRY_RULES).select("case_id", evaluate.outcomes(F.col("found")).alias("outcome"))
    return governance.evaluate_as_of(t.sql(AS_OF), t.sql(ACTIVATIONS), t.sql(VERSIONS), outcomes)


#: Versions of the table with rules of their own: all eight where the id is odd, else six.
OWN_VERSIONS = [packs.Version(str(i), f"h{i}", demo.RULES if i % 2 else demo.RULES[:6], f"{i % 4 * 10:010d}", None if i % 3 == 0 else f"{i % 4 * 10 + 60:010d}", demo.CONFLICTS, demo.NORMS) for i in range(25)]
_OWN = "SELECT asked.request_id, CAST(asked.version_id AS VARCHAR) AS version_id, 'h' || asked.version_id AS version_hash, lpad(CAST(evaluation_date AS VARCHAR), 10, '0') AS evaluation_date, rs.rule_id, effective, f.outcome, related, resolution FROM asked JOIN rs ON rs.case_id = asked.case_id AND (asked.version_id % 2 = 1 OR rs.rule_id < 'R7') JOIN findings f ON f.case_id = rs.case_id AND f.rule_id = rs.rule_id WHERE n = 1"


@query("ev8_evaluate_versions", _conflicts_sql(ALL_LINKS) + f""", sp AS (SELECT * FROM (SELECT *, lead(effective_at) OVER (PARTITION BY pack_id ORDER BY sequence) AS until FROM ({ACTIVATIONS})) WHERE type <> 'DEACTIVATE'),
h AS (SELECT q.request_id, sp.version_id FROM ({AS_OF}) q JOIN ({VERSIONS}) v USING (domain, jurisdiction) JOIN sp USING (version_id) WHERE effective_at <= evaluation_date AND (until IS NULL OR evaluation_date < until) AND valid_from <= evaluation_date AND (valid_to IS NULL OR evaluation_date < valid_to)),
asked AS (SELECT q.request_id, q.case_id, any_value(evaluation_date) AS evaluation_date, count(h.version_id) AS n, max(h.version_id) AS version_id FROM ({AS_OF}) q LEFT JOIN h USING (request_id) GROUP BY ALL), s AS ({snapshot_sql(_OWN, 'evaluation_date')})
SELECT request_id, CASE n WHEN 1 THEN 'FOUND' WHEN 0 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS status, CAST(CASE WHEN n = 1 THEN version_id END AS VARCHAR) AS version_id, CASE WHEN n = 1 THEN 'EVALUATED' END AS code, outcome, content_hash FROM asked LEFT JOIN s USING (request_id)""")
def ev8_versions(t):
    return packs.evaluate_as_of(t.sql(AS_OF), t.sql(ACTIVATIONS), t.sql(VERSIONS), cases(t), OWN_VERSIONS)
