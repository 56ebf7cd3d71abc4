"""Queries of corpus work."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import corpus
from .registry import query

CHUNKS = "SELECT vec_id AS chunk_id, label % 3 AS domain, CASE WHEN vec_id % 4 = 0 THEN 10 ELSE 0 END AS valid_from, CASE WHEN vec_id % 4 = 1 THEN 5 END AS valid_to, {0} AS embedding FROM embeddings"
TOKEN = hashlib.sha256(b"license").hexdigest()


def vectors(t):
    name = next(c for c, kind in t.embeddings.dtypes if kind.startswith("array"))
    return t.sql(CHUNKS.format(name)), t.sql(f"SELECT vec_id AS query_id, label % 3 AS domain, CAST(vec_id % 20 AS INT) AS evaluation_date, {name} AS embedding FROM embeddings WHERE vec_id % 50 = 0")


TOPK = """SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.{0} AS DOUBLE[]), CAST(c.{0} AS DOUBLE[])), 9) AS score
FROM embeddings q JOIN embeddings c ON q.label % 3 = c.label % 3 WHERE q.vec_id % 50 = 0 AND (c.vec_id % 4 <> 0 OR q.vec_id % 20 >= 10) AND (c.vec_id % 4 <> 1 OR q.vec_id % 20 < 5))) WHERE rank <= 5""".replace("{0}", "embedding")


@query("rg3_check_vectors", "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 9 = 0 THEN 'WRONG_DIMENSION' ELSE 'NOT_FINITE' END AS code FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 7 = 0")
def rg3(t):
    c, _ = vectors(t)
    v = F.col("embedding").cast("array<double>")
    v = F.when(F.col("chunk_id") % 9 == 0, F.slice(v, 1, 3)).when(F.col("chunk_id") % 7 == 0, F.concat(F.slice(v, 2, 1000), F.array(F.lit(float("nan"))))).otherwise(v)
    return corpus.check_vectors(c.withColumn("embedding", v), 64)


@query("rg4_retrieve_topk", TOPK.replace("score,", "round(score, 6) AS score,", 1))
def rg4(t):
    c, q = vectors(t)
    return corpus.retrieve_topk(q, c).withColumn("score", F.round("score", 6))


#: Every vector twice, the second time at double length, so that each pair is a tie; some are not approved.
_TWICE = "(SELECT vec_id AS chunk_id, * FROM embeddings UNION ALL SELECT vec_id + 1000000000, * REPLACE (list_transform(embedding, lambda x: x * 2) AS embedding) FROM embeddings)"


@query("rg4_scoped_topk", f"""SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
FROM embeddings q JOIN {_TWICE} c ON q.label % 3 = c.label % 3 AND q.vec_id % 100 = 0 AND c.vec_id % 7 > 0 AND CASE WHEN q.vec_id % 200 = 0 THEN 'EU' ELSE 'UK' END = CASE WHEN c.vec_id % 5 < 3 THEN 'EU' ELSE 'UK' END
AND CASE WHEN c.vec_id % 4 = 0 THEN '2020-06-01' ELSE '2019-01-01' END <= CASE WHEN q.vec_id % 300 = 0 THEN '2020-01-01' ELSE '2021-01-01' END AND (c.vec_id % 4 <> 1 OR CASE WHEN q.vec_id % 300 = 0 THEN '2020-01-01' ELSE '2021-01-01' END < '2021-01-01'))) WHERE rank <= 7""")
def rg4_scoped(t):
    e, v, name = t.embeddings, F.col("vec_id"), next(c for c, kind in t.embeddings.dtypes if kind.startswith("array"))
    c = e.select("vec_id", F.col("label") % 3, F.when(v % 5 < 3, "EU").otherwise("UK"), F.when(v % 7 > 0, "APPROVED").otherwise("DRAFT"), F.when(v % 4 == 0, "2020-06-01").otherwise("2019-01-01"), F.when(v % 4 == 1, "2021-01-01"), F.col(name).cast("array<double>")).toDF("chunk_id", "domain", "jurisdiction", "state", "valid_from", "valid_to", "embedding")
    c = c.unionByName(c.withColumns({"chunk_id": F.col("chunk_id") + 1_000_000_000, "embedding": F.transform("embedding", lambda x: x * 2)}))
    q = e.where(v % 100 == 0).select(v.alias("query_id"), (F.col("label") % 3).alias("domain"), F.when(v % 200 == 0, "EU").otherwise("UK").alias("jurisdiction"), F.when(v % 300 == 0, "2020-01-01").otherwise("2021-01-01").alias("evaluation_date"), F.col(name).alias("embedding"))
    return corpus.retrieve_topk(q, c, 7, ("domain", "jurisdiction")).withColumn("score", F.round("score", 6))


@query("rg2_reject_unapproved", "SELECT doc_id, 'NOT_APPROVED' AS code FROM documents WHERE doc_id % 9 = 0")
def rg2(t):
    s = t.documents.select("doc_id", F.when(F.col("doc_id") % 9 != 0, "APPROVED").otherwise("DRAFT").alias("state"))
    return corpus.reject_unapproved(s)[1].select("doc_id", "code")


@query("rg5_retrieval_metrics", """SELECT round(avg(CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END), 6) AS recall, round(count(*) FILTER (o_orderkey % 3 = 0) / count(*), 6) AS citation_accuracy, round(sum(o_orderkey % 3) / sum(o_orderkey % 3 + o_orderkey % 2), 6) AS faithfulness, round(sum(o_orderkey % 2) / sum(o_orderkey % 3 + o_orderkey % 2), 6) AS unsupported_rate FROM orders""")
def rg5(t):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    rows = t.orders.select(F.when(k % 4 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("expected"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(none).alias("retrieved"), F.array(F.lit("a")).alias("cited"), (k % 3).alias("supported"), (k % 2).alias("unsupported"))
    out = corpus.retrieval_metrics(rows)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("rg6_check_citations", "SELECT event_id AS draft_id, 'c' || (event_id % 11) AS chunk_id FROM events WHERE event_id % 11 >= 5")
def rg6(t):
    d = t.events.select(F.col("event_id").alias("draft_id"), F.array(F.concat(F.lit("c"), (F.col("event_id") % 11).cast("string"))).alias("a"), F.array(F.lit("c0")).alias("b"))
    r = t.events.select(F.col("event_id").alias("draft_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("c"), i.cast("string")))).alias("chunk_id"))
    return corpus.check_citations(d, r, ["a", "b"])


UNITS = "CAST(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER)"
SECRET = 'token = "[0-9a-f]+"'


@query("sca_scan_sensitive", f"""WITH d AS (SELECT 'data/' || doc_id || CASE WHEN doc_id % 10 = 3 THEN '\\private/x' ELSE '' END AS path, text FROM documents), l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
t AS (SELECT path, line, parts, unnest(list_filter(range(1, len(parts) + 1), lambda i: lower(parts[i]) = 'license')) AS i FROM (SELECT path, line, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_-]+|[^\\p{{L}}\\p{{N}}_-]+') AS parts FROM l)),
s AS (SELECT path, line, pieces, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT path, line, string_split_regex(text, '{SECRET}') AS pieces, regexp_extract_all(text, '{SECRET}') AS found FROM l)),
h AS (SELECT path, line, {UNITS.format("array_to_string(parts[:i - 1], '')")} + 1 AS "column", 'FORBIDDEN_TOKEN' AS kind, 'token:{TOKEN}' AS rule FROM t
UNION ALL SELECT path, line, {UNITS.format("array_to_string(pieces[:i], '') || array_to_string(found[:i - 1], '')")} + 1, 'POTENTIAL_SECRET', 'secret:token' FROM s
UNION ALL SELECT path, 1, 1, 'PRIVATE_PATH', 'path:' || sha256('/private/') FROM d WHERE contains(replace(path, chr(92), '/'), '/private/') AND path <> 'data/13' || chr(92) || 'private/x')
SELECT path, CAST(line AS INTEGER) AS line, "column", kind, rule, substr(sha256(kind || chr(0) || rule || chr(0) || path || chr(0) || line), 1, 16) AS fingerprint FROM h""")
def sca(t):
    path = F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 3, "\\private/x").otherwise(""))
    docs = t.documents.select(path.alias("path"), F.col("text").alias("content"))
    return corpus.scan_sensitive(docs, patterns={"token": SECRET}, forbidden=[TOKEN], segments=["/private/"], allowed=["data/13/private/x"])


@query("rg7_safe_retrieve", "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 9 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status, o_orderkey % 9 = 0 AS requires_review, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE coalesce(n, 0) END AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def rg7(t):
    q = t.orders.select(F.col("o_orderkey").alias("query_id"))
    return corpus.safe_retrieve(q, t.lineitem.select(F.col("l_orderkey").alias("query_id")), q.where("query_id % 9 = 0"))
