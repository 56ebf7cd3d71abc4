"""The version in force for requests, against all pairs and with many spans of one scope."""

import random

from pyspark.sql import functions as F

from gavel.operators import ledgers

ACTIVATION, VERSION, REQUEST = "pack_id int, sequence int, type string, version_id string, effective_at int", "version_id string, domain string, jurisdiction string, valid_from int, valid_to int", "request_id int, domain string, jurisdiction string, evaluation_date int"


def test_against_all_pairs(spark):
    rng = random.Random(4)
    versions = [(f"v{i}", rng.choice("ab"), "x", rng.choice([None, 0, 5]), rng.choice([None, 12, 20])) for i in range(8)]
    events = [(p, s, rng.choice(["ACTIVATE", "DEACTIVATE", "DEACTIVATE"]), f"v{rng.randrange(8)}", rng.choice([None, *range(25)])) for p in range(6) for s in range(1, 4)]
    asked = [(i, rng.choice(["a", "b", "c", None]), "x", rng.choice([None, *range(-1, 26)])) for i in range(200)]
    got = {r.request_id: (r.status, r.version_id) for r in ledgers.resolve_pack(spark.createDataFrame(events, ACTIVATION), spark.createDataFrame(versions, VERSION), spark.createDataFrame(asked, REQUEST)).collect()}
    inside = lambda t, a, b: (a is None or a <= t) and (b is None or t < b)
    ends = {(p, s): at for p, s, _, _, at in events}
    for i, domain, _, t in asked:
        hits = [v[0] for p, s, kind, x, at in events for v in versions if kind == "ACTIVATE" and v[0] == x and v[1] == domain and t is not None and inside(t, at, ends.get((p, s + 1))) and inside(t, v[3], v[4])]
        assert got[i] == (("NOT_FOUND", None) if not hits else ("FOUND", hits[0]) if len(hits) == 1 else ("AMBIGUOUS", None))
    assert {s for s, _ in got.values()} == {"FOUND", "NOT_FOUND", "AMBIGUOUS"}


def test_many_spans_and_requests_of_one_scope_do_not_meet(spark):
    n = 200_000
    events = spark.range(n).select(F.col("id").alias("pack_id"), F.lit(1).alias("sequence"), F.lit("ACTIVATE").alias("type"), F.lit("v").alias("version_id"), F.col("id").cast("int").alias("effective_at"))
    asked = spark.range(n).select(F.col("id").alias("request_id"), F.lit("a").alias("domain"), F.lit("x").alias("jurisdiction"), F.col("id").cast("int").alias("evaluation_date"))
    got = ledgers.resolve_pack(events, spark.createDataFrame([("v", "a", "x", None, None)], VERSION), asked).groupBy("status").count().collect()
    assert {tuple(r) for r in got} == {("FOUND", 1), ("AMBIGUOUS", n - 1)}
