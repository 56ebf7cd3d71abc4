"""Graphs of many packs in one pass, and draws by blocks."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gavel.operators import quality, resolution


def test_packs_side_by_side_are_the_packs_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    packs = [None, 3, -2, *range(10, 60)]
    edges = [(p, f"r{rng.randrange(9)}", f"r{rng.randrange(9)}") for p in packs for _ in range(rng.randrange(1, 12))]
    monkeypatch.setattr(resolution, "GRAPHS_ROWS", 17)
    made = resolution.override_graphs(spark.createDataFrame(edges, "pack long, source string, target string"), "pack")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want = []
    for p in packs:
        own = [e for e in edges if e[0] == p]
        want += [(p, *r.values()) for r in resolution.graph(pa.array([e[1] for e in own]), pa.array([e[2] for e in own])).to_pylist()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)
    one = resolution.override_graphs(spark.createDataFrame([e[1:] for e in edges if e[0] == 3], "source string, target string"))
    assert sorted(map(tuple, one.collect()), key=key) == sorted((r[1:] for r in want if r[0] == 3), key=key)


def test_blocks_hold_the_draws_one_by_one(spark, monkeypatch):
    n, iterations, size = 1_000, 3, 64
    want = spark.range(iterations * n).select(F.floor(F.col("id") / n).alias("i"), quality.drawn_case(F.floor(F.col("id") / n).cast("long"), F.col("id") % n, n).alias("c")).groupBy("i", "c").count()
    for block in (1 << 20, 300):
        monkeypatch.setattr(quality, "BLOCK", block)
        got = quality.drawn_cases(spark, iterations, n, size).select("_i", "_part", F.explode("places").alias("p")).select("_i", (F.col("_part") * size + F.col("p")).alias("c")).groupBy("_i", "c").count()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_intervals_do_not_depend_on_the_stretch(spark, monkeypatch):
    cases = spark.range(500).select("id", (F.col("id") % 7).alias("a"), F.lit(3).alias("b")).withColumnRenamed("id", "ordinal")
    metrics = {"share": quality.ratio(F.col("a"), F.col("b"))}
    want = quality.bootstrap_ci(cases, metrics, 20).collect()
    assert want[0].ci_low < want[0].value < want[0].ci_high
    monkeypatch.setattr(quality, "WEIGHTS", 20 * 33)
    assert quality.bootstrap_ci(cases, metrics, 20).collect() == want
    assert quality.bootstrap_ci(cases.where("false"), metrics, 20).first().value == 0


def test_weights_count_the_draws(spark, monkeypatch):
    for n, size, counted in ((1_000, 64, 1 << 24), (1_000, 64, 200), (2, 1, 1)):
        monkeypatch.setattr(quality, "COUNTED", counted)
        monkeypatch.setattr(quality, "BLOCK", 300)
        draws = quality.drawn_cases(spark, 3, n, size).select("_i", "_part", F.explode("places").alias("p")).groupBy("_i", "_part", "p").count().collect()
        got = {}
        for r in quality.drawn_weights(spark, 3, n, size).collect():
            got |= {(r["_i"], r["_part"], p): w + r["more"].count(p) for p, w in enumerate(r["weights"]) if w}
        assert got == {(r["_i"], r["_part"], r["p"]): r["count"] for r in draws}
    one = quality.drawn_weights(spark, 1, 1, 1).first()
    assert (list(one["weights"]), one["more"]) == ([1], [])
    # A case that all of many iterations' draws fall on has more than a byte holds.
    monkeypatch.setattr(quality, "_jumps", lambda steps: (quality.np.zeros(steps, quality.np.uint64),) * 2)
    most = [r for r in quality.drawn_weights(spark, 1, 1_000, 1_000).collect()][0]
    assert most["weights"][0] + len(most["more"]) == 1_000 and set(most["more"]) == {0}


def test_intervals_take_as_many_samples_as_the_benchmark():
    from gavel.plans import registry, sources

    assert sources.ITERATIONS == 200 and "range(200)" in registry.ORACLES["bm5_bootstrap_ci"]
