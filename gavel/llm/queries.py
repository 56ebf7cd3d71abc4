"""The ``opN_<name>`` queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of the encoding query; a file of the ``public_tokenizers`` package.
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vocabulary and end-of-document id of the token files.
FILE_RANKS, END = "byte_bpe_multi_50k.tiktoken", 50_256


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as flat token files, then counts from the files alone; the order in
    which they were written names the documents."""
    import public_tokenizers

    from . import token_counts
    from .common import shared_dir

    folder = shared_dir(spark)
    order = token_counts.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(FILE_RANKS), END)
    if not order.limit(1).count():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counts = token_counts.scan(spark, folder, END, order)
    return order.join(counts.where("closed"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_scoring
    from .common import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    scored = lm_scoring.score(docs, docs.where(~F.col("held_out")))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .common import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = toxicity.fit(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    return model.score(docs).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, path)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ends")


#: Listed rules of the URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filters

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, "block").when(F.col("quality") == 1, "allow").alias("label"))
    return url_filters.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints

    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language
    from .common import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    profiles = language.learn(docs.where(~F.col("held_out")))
    return language.identify(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "text_hash")


#: The contract's rule word by word, without any index.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t, least(13, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (t, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
""".replace("\\\\", "\\")

def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_jaccard

    return ngram_jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    docs = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Every window of every document, joined by its words.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT t, min(doc_id) AS m FROM v GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM v JOIN least_doc USING (t) WHERE doc_id > m),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""



def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as whole numbers, whitened by their eight leading components."""
    from . import whitening

    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").where(~F.exists("embedding", bad))
    # A number beyond a long becomes null, and its row goes as one with a null entry.
    whole = vectors.withColumn("embedding", F.transform("embedding", lambda c: F.try_add(F.floor(c * 1024), F.lit(100_000))))
    model = whitening.fit(whole)
    error, explained = model.identity_error(whole), F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    rows = model.project(whole).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "i").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text (by a hash of its id) first gets a periodic end, as the query's contract has it."""
    from . import periodic_runs

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.col("g")
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    head, root, rest = F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice("w", (F.col("a") + 1).cast("int"), F.col("p")), (n - F.col("a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    docs = docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(head, tail), " ")).alias("text"))
    found = periodic_runs.runs(docs)
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int")), F.lit(0))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_index

    docs = suffix_index.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return docs.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup, "op13_periodic_runs": op13_periodic_runs, "op11_whitening": op11_whitening, "op4_token_counts": op4_token_counts, "op5_lm_scoring": op5_lm_scoring, "op9_ngram_jaccard": op9_ngram_jaccard, "op10_substring_dedup": op10_substring_dedup, "op8_decontamination": op8_decontamination, "op6_toxicity": op6_toxicity, "op2_fingerprints": op2_fingerprints, "op3_language": op3_language, "op1_url_filters": op1_url_filters, "op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {"op10_substring_dedup": OP10_SQL, "op8_decontamination": OP8_SQL}
