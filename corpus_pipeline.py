"""Document pipeline: language, near duplicates, repeated passages, contamination, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import byte_bpe, decontamination, language, ngram_jaccard, substring_dedup
from gavel.llm.common import hidden, saved
from gavel.llm.queries import RANKS

#: Least likeness to a language's profile.
MIN_LANGUAGE_SCORE = 0.25
#: Keys of dropped documents that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose id and text hash are in ``gone (doc_id, text_hash)``."""
    gone = saved(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"])
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or next to nothing of any profile."""
    profiles = language.learn(docs)
    rows, back = hidden(docs, "text")
    known = language.identify(rows, profiles)
    return known.where(language.accepted(known, MIN_LANGUAGE_SCORE)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each component; documents without words have none to
    share.  Rows of one id stay or go together, as do rows without an id of one text."""
    gone = saved(ngram_jaccard.classes(docs).where("NOT stays").select(F.col("node").alias("gone_node")).distinct())
    same = ngram_jaccard.node_key(docs["doc_id"], docs["text"]) == gone["gone_node"]
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, same, "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; what is left of a text is its words
    joined by a space, a text without cuts stays as it is, and one without words left goes."""
    rows, back = hidden(docs, "text")
    id_, chars = (rows.columns[docs.columns.index(c)] for c in ("doc_id", "n_chars"))
    cut = substring_dedup.remove_repeats(rows, id_)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return kept.withColumn("text", text).withColumn(chars, F.length("text").cast("long")).select(*back)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth are benchmark windows; rows of one id and text go together."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    path = public_tokenizers.path(RANKS)
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", "n_tokens", "token_ids", "token_ends", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", contaminated),
    ("byte-level BPE", tokens),
]
#: Byte-level BPE is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
