"""Folds and sweeps over a key's records in order."""

import random
import time

from pyspark.sql import functions as F

from gavel.operators import folds, ledgers


def test_overlaps_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 3)
    rng, rows = random.Random(2), []
    for _ in range(400):
        s = rng.choice([None, *range(60)])
        rows.append((rng.choice(["a", "b", "c", None]), rng.choice([None, *range(12)]), s, rng.choice([None, (s or 0) + rng.choice([-1, 0, 1, 2, 5, 30])])))
    df = spark.createDataFrame(rows, "scope string, pack_id int, start int, end int")
    got = [tuple(r) for r in folds.overlapping_pairs(df, ["scope"], "pack_id").collect()]
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and (r[3] is None or r[2] < r[3])]
    want = {(a[0], a[1], b[1]) for a in fine for b in fine if a[0] == b[0] and a[1] < b[1] and (a[3] is None or b[2] < a[3]) and (b[3] is None or a[2] < b[3])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert folds.overlapping_pairs(df.limit(0), ["scope"], "pack_id").collect() == []


def test_many_disjoint_intervals_of_one_scope(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("pack_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    more = spark.createDataFrame([("s", -1, 55, 75), ("s", -2, 10 * n - 1, None)], "scope string, pack_id long, start long, end long")
    began = time.time()
    assert sorted(tuple(r)[1:] for r in folds.overlapping_pairs(df.unionByName(more), ["scope"], "pack_id").collect()) == [(-2, n - 1), (-1, 5), (-1, 6), (-1, 7)]
    assert time.time() - began < 60


def test_decisions_follow_what_was_accepted(spark):
    ledger = spark.createDataFrame([("r", 1, "a", "d1")], "run_id string, sequence int, content_hash string, decision_id string")
    runs = spark.createDataFrame([("r", "h"), ("q", "h")], "run_id string, run_hash string")
    new = [("r", 1, 2, "a", "b", "h", "d2"), ("r", 2, 2, "a", "z", "h", "d3"), ("r", 3, 3, "x", "c", "h", "d4"), ("r", 4, 3, "b", "c", "h", "d1"), ("r", 5, 3, "b", "c", "h", "d2"), ("r", 6, 3, "b", "c", "h", "d5"), ("r", 7, 4, "c", "d", "o", "d6"), ("q", 1, 1, None, "e", "h", "d7"), ("q", 2, 2, "e", "f", "h", "d8"), ("n", 1, 1, None, "g", "h", "d9"), (None, 1, 1, None, "g", "h", "d10")]
    df = spark.createDataFrame(new, "run_id string, at int, sequence int, previous_hash string, content_hash string, run_hash string, decision_id string")
    got = {(r.run_id, r["at"]): r.status for r in ledgers.append_decisions(ledger, df, runs, order=["at"], decision="decision_id").collect()}
    assert got == {
        ("r", 1): "ACCEPTED", ("r", 2): "SEQUENCE_MISMATCH", ("r", 3): "PREVIOUS_HASH_MISMATCH", ("r", 4): "ALREADY_EXISTS", ("r", 5): "ALREADY_EXISTS", ("r", 6): "ACCEPTED", ("r", 7): "RUN_HASH_MISMATCH",
        ("q", 1): "ACCEPTED", ("q", 2): "ACCEPTED", ("n", 1): "RUN_NOT_FOUND", (None, 1): "RUN_NOT_FOUND",
    }


def test_keys_expire(spark):
    rows = [(i, "k", h, t) for i, (h, t) in enumerate([("a", 0), ("a", 50), ("b", 99), ("b", 100), ("a", 150), ("b", None), ("c", 201)])]
    df = spark.createDataFrame(rows, "n int, key string, request_hash string, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.status for r in ledgers.append_idempotent(df.limit(0), df, ["key"], ["n"], at="ts", expiry=100).orderBy("n").collect()]
    assert got == ["CREATED", "REPLAYED", "CONFLICT", "CREATED", "CONFLICT", "REPLAYED", "CREATED"]


def test_states_of_a_key_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ledgers, "BLOCK", 3)
    rng = random.Random(8)
    events = [(rng.choice(["hot"] * 9 + ["b", None]), rng.choice([None] + list(range(40)) * 2), i, f"s{i}") for i in range(300)]
    asked = [(i, rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(-2, 45)])) for i in range(150)]
    e = spark.createDataFrame(events, "k string, t int, sequence int, state string")
    r = spark.createDataFrame(asked, "request_id int, k string, at int")
    got = {x.request_id: x.state for x in ledgers.state_as_of(e, r, "k", "t", "at", ["sequence"], ["state"]).collect()}
    assert len(got) == 150
    for i, k, at in asked:
        if k is not None and at is not None:
            before = [(t, s, state) for key, t, s, state in events if key == k and t is not None and t <= at]
            known = [x for x in events if x[0] == k and x[1] is None]
            assert got[i] == (max(before)[2] if before else max((s, state) for _, _, s, state in known)[1] if known else None)
