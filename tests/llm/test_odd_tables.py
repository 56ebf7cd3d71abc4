"""Every query of the llm package over empty tables, and over nulls, repeats, ties, long texts and clashing names."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "benchmark"]
NAMES = ["op1_url_filters", "op2_fingerprints", "op3_language", "op4_token_counts", "op5_lm_scoring", "op6_toxicity", "op7_byte_bpe", "op8_decontamination", "op9_ngram_jaccard", "op10_substring_dedup"]
#: Names that operators use for columns of their own.
CLASHES = ["score", "lang_pred", "held_out", "n_words", "n_removed", "kept_text", "bucket", "copy", "features", "prediction", "probability", "margin", "calibrated", "row", "node", "component_id", "stays", "text_hash", "token_ids", "token_ends", "decoded", "doc", "gid", "words", "items", "label", "host", "path", "tokens", "verdict", "rule", "gone_node", "in_0"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    with_clashes = lambda df: df.withColumns({c: F.concat(F.lit(f"own {c} "), F.col(df.columns[0]).cast("string")) for c in CLASHES if c not in df.columns})
    for name in TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        kept = df.orderBy(*df.columns[:1]).limit(60)
        nothing = spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema)
        rows = kept.unionByName(nothing).unionByName(kept.limit(3)).unionByName(kept.limit(4).withColumn(df.columns[0], F.lit(None).cast(df.schema[0].dataType)))
        if name == "documents":
            texts = ["", " \t\n", "123 !!", "word " * 400_000, "x" * 1_000_000, "only one", None, "only one", "\u0000 \U0001f600 é"]
            one = kept.limit(1)
            for i, text in enumerate(texts):
                rows = rows.unionByName(one.withColumns({"doc_id": F.lit(5_000_000 + i).cast(df.schema["doc_id"].dataType), "text": F.lit(text).cast("string")}))
            rows = rows.unionByName(rows.where("doc_id = 5000003").withColumn("doc_id", F.col("doc_id") + 100))
        with_clashes(rows).write.parquet(f"{folder}/{name}.parquet")
    return folder


def table_of(name):
    return "pages" if name.startswith("op1_") else "documents"


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_have_a_result(spark, odd, name):
    given = spark.read.parquet(f"{odd}/{table_of(name)}.parquet")
    out = entry.queries()[name](spark, odd)
    usual = entry.queries()[name](spark, SF)
    assert out.dtypes == usual.dtypes
    key = out.columns[0]
    ids = lambda df: sorted(((r[0] is None, r[0] or 0) for r in df.select(key).collect()))
    assert ids(out) == ids(given)


def test_pipeline_over_odd_tables(spark, odd, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, odd))
        assert docs.columns == spark.read.parquet(f"{odd}/documents.parquet").columns, name
    for r in docs.collect():
        assert all(r[c] == (None if r.doc_id is None else f"own {c} {r.doc_id}") for c in CLASHES)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert out.count() == docs.count() > 10
