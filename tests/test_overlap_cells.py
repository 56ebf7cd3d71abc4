"""Intervals of a scope that all start alike are dealt into groups of bounded size."""

from pyspark.sql import functions as F

from gavel.operators import folds


def test_like_starts(spark, monkeypatch):
    monkeypatch.setattr(folds, "CELL", 8)
    n = 60
    df = spark.range(2 * n).select(F.lit("s").alias("scope"), (F.col("id") % n).alias("pack_id"), F.lit(5).alias("start"), F.when(F.col("id") % 2 == 0, 9).alias("end"))
    got = [tuple(r)[1:] for r in folds.overlapping_pairs(df, ["scope"], "pack_id").collect()]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_pairs_of_dense_scopes_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(folds, "KEYS", 16)
    monkeypatch.setattr(folds, "BLOCK", 50)
    k = F.col("id") % 90
    df = spark.range(900).select((k % 2).alias("scope"), k.alias("pack_id"), F.timestamp_seconds(F.col("id") * 7 % 1000).alias("start"), F.when(F.col("id") % 5 > 0, F.timestamp_seconds(F.col("id") * 7 % 1000 + F.col("id") % 11 * 9)).alias("end"))
    out = folds.overlapping_pairs(df, ["scope"], "pack_id")
    got = [tuple(r) for r in out.collect()]
    a, b = df.alias("a"), df.alias("b")
    meets = F.expr("a.scope = b.scope and a.pack_id < b.pack_id and (a.end is null or a.start < a.end) and (b.end is null or b.start < b.end) and (a.end is null or b.start < a.end) and (b.end is null or a.start < b.end)")
    want = {tuple(r) for r in a.join(b, meets).select("a.scope", "a.pack_id", "b.pack_id").collect()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "pack_id_a" not in plan.split("MapInArrow", 1)[1] and "Aggregate" not in plan.split("MapInArrow", 1)[0]
