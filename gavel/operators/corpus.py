"""Corpus work: vector checks and retrieval, citation checks, retrieval metrics, sensitive text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import nearest

#: Patterns of secrets; fixed values.
SECRETS = {
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b",
    "openai-token": r"\bsk-[A-Za-z0-9_-]{32,}\b",
}


def check_vectors(df: DataFrame, dims: int, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """``(key, code)`` of vectors of another length or with values that are not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    code = F.when(F.col(vector).isNull() | (F.size(vector) != dims), "WRONG_DIMENSION").when(bad, "NOT_FINITE")
    return df.select(key, code.alias("code")).where("code is not null")


def reject_unapproved(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved sections, and the others as violations."""
    return sections.where("state = 'APPROVED'"), sections.where("state is distinct from 'APPROVED'").withColumn("code", F.lit("NOT_APPROVED"))


def retrieve_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, scope: tuple[str, ...] = ("domain",), vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest approved chunks of each query in its scope and valid at its date; see ``nearest.nearest``."""
    return nearest(queries, chunks, k, scope, vector)


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """Macro recall, micro citation accuracy, faithfulness and the share unsupported; 0 / 0 is 1.

    ``cases``: expected, retrieved and cited arrays, supported and unsupported counts.
    """
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.nullif(b, F.lit(0)))
    e, r, c = (F.array_distinct(x) for x in ("expected", "retrieved", "cited"))
    both = F.col("supported") + F.col("unsupported")
    return cases.agg(
        F.avg(ratio(F.size(F.array_intersect(e, r)), F.size(e))).alias("recall"), ratio(F.sum(F.size(F.array_intersect(c, r))), F.sum(F.size(c))).alias("citation_accuracy"),
        ratio(F.sum("supported"), F.sum(both)).alias("faithfulness"), ratio(F.sum("unsupported"), F.sum(both)).alias("unsupported_rate"),
    )


def check_citations(drafts: DataFrame, retrieved: DataFrame, lists: list[str], key: str = "draft_id") -> DataFrame:
    """``(key, chunk_id)`` of cited chunks that were not retrieved for the draft."""
    cited = drafts.select(key, F.explode(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))).alias("chunk_id"))
    return cited.join(retrieved.select(key, "chunk_id"), [key, "chunk_id"], "left_anti")


def scan_sensitive(docs: DataFrame, path: str = "path", content: str = "content", patterns: dict[str, str] | None = None, forbidden: list[str] | None = None, segments: list[str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """``(path, kind, rule, line, column, fingerprint)`` of every secret by pattern, every token whose hash is
    forbidden, and every forbidden path segment of a path that is not allowed.

    Columns count UTF-16 units from 1.  Patterns match within a line.  Findings of paths are at 1, 1.
    """
    from ..functions.hashing import finding_fingerprint, token_hash
    from ..functions.text import utf16_length

    where = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    banned = F.array(*[F.when(where.contains(s) & ~where.isin(allowed or []), F.concat(F.lit("path:"), token_hash(F.lit(s)))) for s in segments or []]).cast("array<string>")
    paths = docs.select(F.col(path).alias("path"), F.lit("PRIVATE_PATH").alias("kind"), F.explode(F.array_compact(banned)).alias("rule"), F.lit(1).alias("line"), F.lit(1).alias("column"))

    column = lambda before: (utf16_length(F.array_join(before, "")) + 1).cast("int")
    hit = lambda kind, rule, at: F.struct(F.lit(kind).alias("kind"), rule.alias("rule"), at.alias("column"))
    none = F.array().cast("array<struct<kind:string,rule:string,column:int>>")
    line = F.col("text")

    def secrets(name: str, pattern: str):
        between, found = F.split(line, pattern), F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1))
        ahead = lambda i: F.concat(F.slice(between, 1, i + 1), F.slice(found, 1, i))
        return F.when(line.rlike(pattern), F.transform(found, lambda _, i: hit("POTENTIAL_SECRET", F.lit(f"secret:{name}"), column(ahead(i))))).otherwise(none)

    hits = [secrets(*rule) for rule in (SECRETS | (patterns or {})).items()]
    if forbidden:
        # Tokens and what is between them, in turn.
        parts = F.regexp_extract_all(line, F.lit(r"([\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+)"), F.lit(1))
        places = F.transform(parts, lambda x, i: F.struct(token_hash(x).alias("hash"), i.alias("i")))
        places = F.filter(places, lambda x: x["hash"].isin(forbidden))
        hits.append(F.transform(places, lambda x: hit("FORBIDDEN_TOKEN", F.concat(F.lit("token:"), x["hash"]), column(F.slice(parts, 1, x["i"])))))
    lines = docs.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n")).alias("n", "text"))
    found = lines.select("path", (F.col("n") + 1).alias("line"), F.explode(F.concat(*hits)).alias("hit")).select("path", "hit.kind", "hit.rule", "line", "hit.column")
    return found.unionByName(paths).withColumn("fingerprint", finding_fingerprint(F.col("kind"), F.col("rule"), F.col("path"), F.col("line")))


def safe_retrieve(queries: DataFrame, retrieved: DataFrame, violations: DataFrame) -> DataFrame:
    """``(query_id, status, requires_review, n)``: UNAVAILABLE for queries with a violation, whatever was retrieved."""
    bad = violations.select("query_id").distinct().withColumn("_bad", F.lit(True))
    n = retrieved.groupBy("query_id").agg(F.count("*").alias("_n"))
    rows = queries.select("query_id").join(bad, "query_id", "left").join(n, "query_id", "left")
    failed = F.col("_bad").isNotNull()
    return rows.select("query_id", F.when(failed, "UNAVAILABLE").otherwise("AVAILABLE").alias("status"), failed.alias("requires_review"), F.when(failed, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n"))
