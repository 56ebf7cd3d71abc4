"""Queries of metrics, calibration, impact and data audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .registry import query

EXPECTED = """SELECT o_orderkey AS case_id, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'large', CASE WHEN o_totalprice > 200000 THEN 'y' ELSE 'n' END FROM orders"""
PREDICTED = f"""SELECT case_id, key, CASE WHEN case_id % 7 = 0 THEN concat(value, '?') ELSE value END AS value FROM ({EXPECTED}) q WHERE NOT (case_id % 5 = 0 AND key = 'status') UNION ALL SELECT o_orderkey, 'extra', 'x' FROM orders WHERE o_orderkey % 6 = 0"""
CASES = """SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'NOT_APPLICABLE' END AS expected, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'REVIEW' WHEN o_orderkey % 10 = 3 THEN 'PASS' WHEN o_orderstatus = 'F' THEN 'FAIL' WHEN o_orderstatus = 'O' THEN 'PASS' ELSE 'NOT_APPLICABLE' END AS predicted FROM orders"""
OBS = """SELECT doc_id, coalesce(lang, '?') AS lang, (n_chars % 101) / 100e0 AS score, quality = 1 AS correct, CASE WHEN doc_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS proposed_outcome, CASE WHEN toxic = 1 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM labels JOIN documents USING (doc_id)"""
COUNTS = f"""SELECT count(*) FILTER (e AND p AND want = got) AS tp, count(*) FILTER (p AND NOT coalesce(e AND want = got, false)) AS fp, count(*) FILTER (e AND NOT coalesce(p AND want = got, false)) AS fn, count(*) FILTER (e AND p IS NULL) AS missing, count(*) FILTER (p AND e IS NULL) AS hallucinated, count(*) FILTER (e) AS expected, count(*) FILTER (p) AS predicted
FROM (SELECT case_id, key, value AS want, true AS e FROM ({EXPECTED})) FULL JOIN (SELECT case_id, key, value AS got, true AS p FROM ({PREDICTED})) USING (case_id, key)"""


def rounded(df, *keep):
    return df.select(*[c if c in keep else F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns])


@query("bm1_extraction_counts", COUNTS)
def bm1(t):
    return quality.extraction_counts(t.sql(EXPECTED), t.sql(PREDICTED))


@query("bm2_extraction_metrics", f"SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(missing / expected, 6) AS missing_rate, round(hallucinated / predicted, 6) AS hallucination_rate FROM ({COUNTS})")
def bm2(t):
    return rounded(quality.extraction_metrics(bm1(t)))


@query("bm3_finding_metrics", f"SELECT round(count(*) FILTER (e AND p) / count(*) FILTER (e), 6) AS sensitivity, round(count(*) FILTER (NOT e AND NOT p) / count(*) FILTER (NOT e), 6) AS specificity, round(count(*) FILTER (e AND NOT p) / count(*) FILTER (e), 6) AS false_negative_rate FROM (SELECT expected = 'FAIL' AS e, coalesce(predicted, 'REVIEW') = 'FAIL' AS p FROM ({CASES}))")
def bm3(t):
    return rounded(quality.finding_metrics(t.sql(CASES)))


@query("bm4_macro_f1", f"SELECT round(sum(coalesce(2 * tp / nullif(2 * tp + off, 0), 0)) / 4, 6) AS macro_f1 FROM (SELECT o, count(*) FILTER (expected = o AND p = o) AS tp, count(*) FILTER ((expected = o) <> (p = o)) AS off FROM (SELECT expected, coalesce(predicted, 'REVIEW') AS p FROM ({CASES})), (VALUES ('FAIL'), ('REVIEW'), ('PASS'), ('NOT_APPLICABLE')) v(o) GROUP BY o)")
def bm4(t):
    return rounded(quality.macro_f1(t.sql(CASES)))


@query("bm6_split_cases", "SELECT case_id, CASE WHEN h < 60 THEN 'train' WHEN h < 80 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT o_orderkey AS case_id, CAST('0x' || substr(sha256('42|' || o_orderkey), 1, 8) AS BIGINT) % 100 AS h FROM orders)")
def bm6(t):
    return quality.split_cases(t.orders.select(F.col("o_orderkey").alias("case_id")))


@query("bm7_latency_summary", "SELECT min(x) AS min, round(avg(x), 6) AS mean, quantile_disc(x, 0.95) AS p95, max(x) AS max FROM (SELECT event_id % 977 AS x FROM events)")
def bm7(t):
    return rounded(quality.latency_summary(t.events.select((F.col("event_id") % 977).alias("x")), "x").withColumn("p95", F.col("p95").cast("long")), "min", "p95", "max")


@query("bm8_pipeline_report", f"SELECT count(*) FILTER (predicted = 'NOT_APPLICABLE') AS not_applicable, count(*) FILTER (predicted = 'PASS') AS pass, count(*) FILTER (predicted = 'REVIEW') AS review, count(*) FILTER (predicted = 'FAIL') AS fail, count(*) FILTER (expected = predicted) AS matched, round(count(*) FILTER (predicted = 'REVIEW') / count(*), 6) AS review_rate FROM ({CASES})")
def bm8(t):
    return rounded(quality.pipeline_report(t.sql(CASES)), "not_applicable", "pass", "review", "fail", "matched")


BIN = "CAST(" + " + ".join(f"CASE WHEN score >= {i / 10} THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS INTEGER)"


@query("ca2_reliability_bins", f"SELECT lang, bin, coalesce(n, 0) AS n, coalesce(mean_score, 0) AS mean_score, coalesce(accuracy, 0) AS accuracy FROM (SELECT lang, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT lang FROM ({OBS})), range(10) r(b)) LEFT JOIN (SELECT lang, {BIN} AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM ({OBS}) GROUP BY ALL) USING (lang, bin)")
def ca2(t):
    return rounded(quality.reliability_bins(t.sql(OBS), 10, "lang"), "lang", "bin", "n")


CURVE = f"SELECT lang, score AS threshold, c / max(c) OVER (PARTITION BY lang) AS coverage, bad / c AS risk, CAST(c AS BIGINT) AS count FROM (SELECT lang, score, sum(n) OVER w AS c, sum(wrong) OVER w AS bad FROM (SELECT lang, score, count(*) AS n, count(*) FILTER (NOT correct) AS wrong FROM ({OBS}) GROUP BY ALL) WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"


@query("ca3_risk_coverage", f"SELECT lang, threshold, round(coverage, 6) AS coverage, round(risk, 6) AS risk, count FROM ({CURVE})")
def ca3(t):
    return rounded(quality.risk_coverage(t.sql(OBS), "lang"), "lang", "threshold", "count")


@query("ca4_choose_threshold", f"SELECT lang, arg_max(threshold, struct_pack(a := coverage, b := -threshold)) AS threshold, round(max(coverage), 6) AS coverage FROM ({CURVE}) WHERE count >= 10 AND risk <= 0.2 GROUP BY lang")
def ca4(t):
    return rounded(quality.choose_threshold(quality.risk_coverage(t.sql(OBS), "lang"), 0.2, 10, "lang"), "lang", "threshold")


@query("ca7_apply_calibration", f"SELECT doc_id, CASE WHEN lang = 'es' THEN 'NO_PROFILE' WHEN lang = 'fr' THEN 'INSUFFICIENT_SAMPLES' WHEN proposed_outcome = 'PASS' AND risk_level = 'HIGH' THEN 'HIGH_RISK_PASS_BLOCKED' WHEN score < 0.4 THEN 'BELOW_THRESHOLD' ELSE 'ALLOW' END AS decision FROM ({OBS})")
def ca7(t):
    rows = quality.apply_calibration(t.sql(OBS), F.col("lang") != "es", F.when(F.col("lang") == "fr", 3).otherwise(100), 20, F.lit(0.4))
    return rows.select("doc_id", "decision")


IMPACT = f"SELECT case_id, expected AS before, coalesce(predicted, 'REVIEW') AS after FROM ({CASES})"


@query("rt4_impact", f"SELECT case_id, before, after, array_to_string(list_filter([CASE WHEN before <> after THEN 'OUTCOME_CHANGED' END, CASE WHEN after = 'REVIEW' AND before <> 'REVIEW' THEN 'NEW_REVIEW' END, CASE WHEN before IN ('FAIL', 'REVIEW') AND after IN ('PASS', 'NOT_APPLICABLE') THEN 'POSSIBLE_FALSE_CONFORMITY' END, CASE WHEN before = after THEN 'UNCHANGED' END], lambda x: x IS NOT NULL), ',') AS labels FROM ({IMPACT})")
def rt4(t):
    return impacts(t).withColumn("labels", F.concat_ws(",", "labels"))


def impacts(t):
    c = t.sql(CASES)
    return quality.impact(c.select("case_id", F.col("expected").alias("outcome")), c.select("case_id", F.coalesce("predicted", F.lit("REVIEW")).alias("outcome")), "case_id")


@query("rt5_impact_summary", f"SELECT count(*) AS total, count(*) FILTER (before <> after) AS changed, count(*) FILTER (after = 'REVIEW' AND before <> 'REVIEW') AS new_review, count(*) FILTER (before IN ('FAIL', 'REVIEW') AND after IN ('PASS', 'NOT_APPLICABLE')) AS possible_false_conformity, count(*) FILTER (before = after) AS unchanged FROM ({IMPACT})")
def rt5(t):
    return quality.impact_summary(impacts(t))


@query("dq1_collection_counts", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 8 END AS expected, coalesce(n, 0) AS found, o_orderkey % 7 = 0 OR coalesce(n, 0) = o_orderkey % 8 AS matches, CAST(d AS BIGINT) AS declared, coalesce(d = n, false) AS declared_matches FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k, CASE WHEN count(*) FILTER (l_partkey % 50 IN (0, 1)) = 0 THEN sum(CASE WHEN l_partkey % 50 = 2 THEN 2 ELSE 1 END) END AS d FROM lineitem GROUP BY ALL) ON k = o_orderkey""")
def dq1(t):
    part = F.col("l_partkey") % 50
    declared = t.lineitem.select(F.col("l_orderkey").alias("id"), F.when(part == 0, -1).when(part == 2, 2).when(part != 1, 1).alias("declared"))
    expected = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 8).alias("expected"))
    return quality.collection_counts(t.lineitem.select(F.col("l_orderkey").alias("id")), expected, "id", declared)


@query("dq2_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS issues FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq2(t):
    return quality.duplicate_ids(t.lineitem, "l_orderkey", "l_linenumber")


REF = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN l_partkey + 100000000 ELSE l_partkey END AS ref FROM lineitem"


@query("dq3_missing_references", f"SELECT ref, l_orderkey, l_linenumber FROM ({REF}) WHERE ref NOT IN (SELECT p_partkey FROM part)")
def dq3(t):
    return quality.missing_references(t.sql(REF), "ref", t.part, "p_partkey")


@query("dq4_relationship_check", f"SELECT l_linenumber, count(*) AS total, count(p_partkey) AS resolved, count(*) - count(p_partkey) AS missing FROM ({REF}) LEFT JOIN part ON p_partkey = ref GROUP BY l_linenumber")
def dq4(t):
    return quality.relationship_check(t.sql(REF), "ref", t.part, "p_partkey", "l_linenumber")


@query("dq5_completeness", """SELECT lang, field, state, count(*) AS n FROM (SELECT lang, 'text' AS field, CASE WHEN text IS NULL THEN 'MISSING' WHEN length(trim(text)) = 0 THEN 'INVALID' ELSE 'COMPLETE' END AS state FROM documents UNION ALL SELECT lang, 'source', CASE WHEN source IS NULL THEN 'MISSING' WHEN source IN ('src0', 'src1') THEN 'INVALID' ELSE 'COMPLETE' END FROM documents UNION ALL SELECT lang, 'n_chars', CASE WHEN n_chars IS NULL THEN 'MISSING' WHEN n_chars <= 500 THEN 'INVALID' ELSE 'COMPLETE' END FROM documents) GROUP BY ALL""")
def dq5(t):
    c = F.col
    return quality.completeness(t.documents, {"text": (c("text").isNotNull(), F.length(F.trim("text")) > 0), "source": (c("source").isNotNull(), ~c("source").isin("src0", "src1")), "n_chars": (c("n_chars").isNotNull(), c("n_chars") > 500)}, "lang")


@query("dq6_map_outcomes", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'PASS' WHEN 'error' THEN 'FAIL' ELSE 'REVIEW' END AS outcome, event_type NOT IN ('signup', 'error') AS unmapped FROM events")
def dq6(t):
    return quality.map_outcomes(t.events, "event_type", {"signup": "PASS", "error": "FAIL"}).select("event_id", "outcome", "unmapped")


SPLIT = "CASE WHEN doc_id % 5 < 3 THEN 'calibration' ELSE 'test' END"


@query("ca1_observations", f"SELECT case_id, 'test' AS split, 0.5 AS score, coalesce(predicted, 'REVIEW') = expected AS correct, coalesce(predicted, 'REVIEW') AS proposed_outcome, 'LOW' AS risk_level FROM ({CASES})".replace("0.5 AS score", "0.5::DOUBLE AS score"))
def ca1(t):
    c = t.sql(CASES)
    return quality.observations(c.select("case_id", "expected", F.lit("test").alias("split"), F.lit(0.5).alias("score"), F.lit("LOW").alias("risk_level")), c.where("predicted is not null").select("case_id", "predicted"))


@query("ca5_fit_profile", "WITH o AS (SELECT * FROM (" + OBS + f") WHERE {SPLIT} = 'calibration'), c AS (" + CURVE.replace(f"({OBS})", "o") + ") SELECT lang, samples, threshold FROM (SELECT lang, count(*) AS samples FROM o GROUP BY lang) LEFT JOIN (SELECT lang, arg_max(threshold, struct_pack(a := coverage, b := -threshold)) AS threshold FROM c WHERE count >= 5 AND risk <= 0.2 GROUP BY lang) USING (lang)")
def ca5(t):
    return quality.fit_profile(t.sql(OBS).withColumn("split", F.expr(SPLIT)), 0.2, 5, "lang")


PROFILES = "SELECT s_suppkey AS profile_id, s_nationkey % 5 AS model, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 7 END AS fact_key, s_suppkey AS ordinal, s_suppkey % 4 <> 0 AS usable FROM supplier"


@query("ca6_select_profile", f"WITH f AS (SELECT * FROM ({PROFILES}) QUALIFY row_number() OVER (PARTITION BY model, fact_key ORDER BY ordinal) = 1) SELECT c_custkey AS request_id, coalesce(CASE WHEN a.usable THEN a.profile_id END, CASE WHEN b.usable THEN b.profile_id END) AS profile_id FROM customer LEFT JOIN f a ON a.model = c_nationkey % 5 AND a.fact_key = c_custkey % 9 LEFT JOIN f b ON b.model = c_nationkey % 5 AND b.fact_key IS NULL")
def ca6(t):
    r = t.customer.select(F.col("c_custkey").alias("request_id"), (F.col("c_nationkey") % 5).alias("model"), (F.col("c_custkey") % 9).alias("fact_key"))
    return quality.select_profile(r, t.sql(PROFILES))


@query("rt2_coverage", "SELECT CAST(u AS VARCHAR) AS rule_id, t AS tag FROM (SELECT DISTINCT user_id AS u FROM events), (VALUES ('signup'), ('error'), ('view')) v(t) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u AND e.event_type = t AND event_id % 40 = 1)")
def rt2(t):
    r = t.events.select(F.col("user_id").cast("string").alias("rule_id"), F.array("event_type").alias("tags"), (F.col("event_id") % 40 == 1).alias("passed"))
    return quality.coverage(r.select("rule_id").distinct(), ["signup", "error", "view"], r)


@query("rt3_gate", "SELECT coalesce(a.version, b.version) AS version, coalesce(failures, 0) AS failures, coalesce(missing, 0) AS missing, coalesce(failures, 0) = 0 AND coalesce(missing, 0) = 0 AS ready FROM (SELECT user_id AS version, count(*) FILTER (event_id % 40 = 0) AS failures FROM events GROUP BY ALL) a FULL JOIN (SELECT c_custkey AS version, count(*) AS missing FROM customer WHERE c_custkey % 7 = 0 GROUP BY ALL) b ON a.version = b.version")
def rt3(t):
    r = t.events.select(F.col("user_id").alias("version"), (F.col("event_id") % 40 != 0).alias("passed"))
    return quality.gate(r, t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("version")), "version")


@query("dq7_audit_summary", "WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS c, n_chars, doc_id FROM documents), g AS (SELECT substr(sha256(path), 1, 2) AS g, sha256(string_agg(c, '' ORDER BY path)) AS h FROM f GROUP BY ALL) SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) FILTER (doc_id % 10 > 1) AS valid, count(*) FILTER (doc_id % 10 = 1) AS warning, count(*) FILTER (doc_id % 10 = 0) AS error, (SELECT sha256(string_agg(h, '' ORDER BY g)) FROM g) AS corpus_sha FROM f")
def dq7(t):
    k = F.col("doc_id") % 10
    return quality.audit_summary(t.documents.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha"), F.col("n_chars").alias("bytes"), F.when(k == 0, "ERROR").when(k == 1, "WARNING").otherwise("VALID").alias("severity")))


@query("dq8_stale_sources", "SELECT CAST(doc_id AS VARCHAR) AS path, 'STALE_SOURCE' AS code FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'STALE_FILE_MISSING' FROM documents WHERE doc_id % 6 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def dq8(t):
    s = t.documents.select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 6 == 0).alias("stale"))
    return quality.stale_sources(s, t.labels.select(F.col("doc_id").cast("string").alias("path")))


@query("dq9_budget_check", "WITH s AS (SELECT source, count(*) FILTER (n_chars > 10000) AS large, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source) SELECT source, 'FILE_TOO_LARGE' AS code, large AS n FROM s WHERE large > 0 UNION ALL SELECT source, 'TOO_MANY_FILES', files FROM s WHERE files > 45 UNION ALL SELECT source, 'TOO_MANY_BYTES', total FROM s WHERE total > 110000")
def dq9(t):
    return quality.budget_check(t.documents.select("source", F.col("n_chars").alias("bytes")), 10_000, "source", max_files=45, max_total=110_000)
