"""Evaluation quality: extraction and outcome metrics, calibration, version impact, data audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import OUTCOMES


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b; ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.nullif(b, F.lit(0)))


def extraction_counts(expected: DataFrame, predicted: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, missing, hallucinated over (case_id, key); a wrong value counts as fp and fn."""
    e = expected.select("case_id", "key", F.col("value").alias("want"), F.lit(True).alias("in_e"))
    p = predicted.select("case_id", "key", F.col("value").alias("got"), F.lit(True).alias("in_p"))
    both = e.join(p, ["case_id", "key"], "full_outer")
    inside, guessed = F.col("in_e").isNotNull(), F.col("in_p").isNotNull()
    right = inside & guessed & (F.col("want") == F.col("got"))
    counts = {"tp": right, "fp": guessed & ~F.coalesce(right, F.lit(False)), "fn": inside & ~F.coalesce(right, F.lit(False)), "missing": inside & ~guessed, "hallucinated": guessed & ~inside}
    return both.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.count_if(inside).alias("expected"), F.count_if(guessed).alias("predicted"))


def extraction_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(F.col("missing"), F.col("expected")).alias("missing_rate"), ratio(F.col("hallucinated"), F.col("predicted")).alias("hallucination_rate"),
    )


def finding_metrics(cases: DataFrame) -> DataFrame:
    """Sensitivity, specificity and false-negative rate with FAIL as positive; no prediction is REVIEW."""
    bad, said = F.col("expected") == "FAIL", F.coalesce("predicted", F.lit("REVIEW")) == "FAIL"
    sums = cases.agg(F.count_if(bad & said).alias("tp"), F.count_if(bad & ~said).alias("fn"), F.count_if(~bad & ~said).alias("tn"), F.count_if(~bad & said).alias("fp"))
    return sums.select(ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"), ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), ratio(F.col("fn"), F.col("tp") + F.col("fn")).alias("false_negative_rate"))


def macro_f1(cases: DataFrame) -> DataFrame:
    """Mean F1 over the four outcomes; an outcome that never occurs counts as 0."""
    got = F.coalesce("predicted", F.lit("REVIEW"))
    sums = cases.agg(*[x for o in OUTCOMES for x in (F.count_if((F.col("expected") == o) & (got == o)).alias(f"tp_{o}"), F.count_if((F.col("expected") == o) != (got == o)).alias(f"off_{o}"))])
    return sums.select((sum(ratio(2 * F.col(f"tp_{o}"), 2 * F.col(f"tp_{o}") + F.col(f"off_{o}")) for o in OUTCOMES) / 4).alias("macro_f1"))


def split_cases(cases: DataFrame, case: str = "case_id", seed: str = "42") -> DataFrame:
    """A stable 60/20/20 split by the hash of the case id."""
    part = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col(case).cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(100))
    return cases.select(case, F.when(part < 60, "train").when(part < 80, "calibration").otherwise("test").alias("split"))


def latency_summary(rows: DataFrame, value: str) -> DataFrame:
    """Minimum, mean, 95th percentile (an observed value) and maximum."""
    return rows.agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("max"))


#: The generator that draws cases: multiplier, increment and seeds; fixed values.
LCG, SEED, SEED_STEP = (1_664_525, 1_013_904_223), 42, 2_654_435_761
WORD = 2**32


def _times(a: Column, b: Column) -> Column:
    """a * b modulo 2^32 without leaving 64 bits."""
    high, low = F.floor(b / 65_536).cast("long"), b % 65_536
    return ((a * high) % 65_536 * 65_536 + a * low) % WORD


def drawn_case(iteration: Column, draw: Column, cases: int) -> Column:
    """The place of the case that a draw (from 0) of an iteration takes.  The generator is run ahead by the binary
    digits of the draw, so every draw is an expression of its own."""
    jumps, (a, c) = [], LCG
    for bit in range(max(1, cases.bit_length())):
        jumps.append(F.struct(F.lit(2**bit).cast("long").alias("steps"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")))
        a, c = a * a % WORD, (c * a + c) % WORD
    first = ((F.lit(SEED) + iteration * SEED_STEP) % WORD).cast("long")
    state = F.aggregate(F.array(*jumps), first, lambda s, x: F.when(F.floor((draw + 1) / x["steps"]) % 2 == 1, (_times(s, x["a"]) + x["c"]) % WORD).otherwise(s))
    return state % cases


#: Draws that a task makes at a time, and weights of cases (cases times iterations) that it holds at a time.
BLOCK, WEIGHTS = 1 << 20, 1 << 20
#: Places of cases whose weights a task counts at a time, about.
COUNTED = 1 << 24


def _jumps(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments that run the generator 1 to ``steps`` draws ahead."""
    a, c = np.array([LCG[0]], np.uint64), np.array([LCG[1]], np.uint64)
    while len(a) < steps:
        a, c = np.append(a, a * a[-1] % WORD), np.append(c, (a * c[-1] + c) % WORD)
    return a[:steps], c[:steps]


def _state(iteration: int, draws: int) -> int:
    """The generator of an iteration after a number of draws, by their binary digits."""
    (a, c), state = LCG, (SEED + iteration * SEED_STEP) % WORD
    while draws:
        if draws & 1:
            state = (state * a + c) % WORD
        a, c, draws = a * a % WORD, (c * a + c) % WORD, draws >> 1
    return state


def drawn_cases(spark: SparkSession, iterations: int, cases: int, size: int) -> DataFrame:
    """``(_part, _i, places)``: the places of cases that all iterations draw, in stretches of ``size`` cases, as places within
    the stretch.  A task makes a block of draws at a time."""
    block = BLOCK
    blocks = -(-cases // block)

    def drawn(batches):
        a, c = _jumps(min(block, cases))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, first = k // blocks, k % blocks * block
                n = min(block, cases - first)
                places = np.sort((a[:n] * np.uint64(_state(i, first)) + c[:n]) % WORD % np.uint64(cases)).astype(np.int64)
                parts, starts = np.unique(places // size, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, n).astype(np.int32)), pa.array((places % size).astype(np.int32)))
                yield pa.record_batch([pa.array(parts), pa.array(np.full(len(parts), i, np.int64)), lists], names=["_part", "_i", "places"])

    return spark.range(iterations * blocks).repartition("id").mapInArrow(drawn, "_part long, _i long, places array<int>")


def drawn_weights(spark: SparkSession, iterations: int, cases: int, size: int) -> DataFrame:
    """``(_part, _i, weights, more)``: how often all iterations draw the cases of a stretch of ``size`` places, a byte for each,
    and once more the places of what is beyond 255.  A task goes through the draws of an iteration by blocks and counts those of about
    ``COUNTED`` places, so that a draw takes less than a byte of the shuffle."""
    stride = max(1, COUNTED // size) * size
    spans = -(-cases // stride)

    def drawn(batches):
        a, c = _jumps(min(BLOCK, cases))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, low = k // spans, k % spans * stride
                counts = np.zeros(min(stride, cases - low), np.uint32)
                for first in range(0, cases, BLOCK):
                    n = min(BLOCK, cases - first)
                    places = ((a[:n] * np.uint64(_state(i, first)) + c[:n]) % WORD % np.uint64(cases)).astype(np.int64) - low
                    np.add.at(counts, places if spans == 1 else places[(places >= 0) & (places < len(counts))], np.uint32(1))
                many = max(1, BLOCK // size) * size
                for start in range(0, len(counts), many):
                    own = [counts[at : at + size] for at in range(start, min(start + many, len(counts)), size)]
                    more = [np.repeat(high, x[high] - 255).astype(np.int32) for x in own for high in [np.flatnonzero(x > 255)]]
                    parts = (low + start) // size + np.arange(len(own))
                    yield pa.record_batch([pa.array(parts), pa.array(np.full(len(own), i)), pa.array([np.minimum(x, 255).astype(np.uint8).tobytes() for x in own], pa.binary()), pa.array(more, pa.list_(pa.int32()))], names=["_part", "_i", "weights", "more"])

    return spark.range(iterations * spans).repartition("id").mapInArrow(drawn, "_part long, _i long, weights binary, more array<int>")


def bootstrap_ci(cases: DataFrame, metrics: dict[str, Column], iterations: int = 200, ordinal: str = "ordinal") -> DataFrame:
    """``(metric, value, ci_low, ci_high)``: the metric over all cases, and the 2.5 and 97.5 percentiles (the lower
    nearest one) over samples of as many cases with replacement, widened to hold the value.

    ``cases``: a row each with its place from 0 and whole-number columns; ``metrics`` are expressions over their sums.
    A sample is a number of times for each case.  These and the cases are dealt by stretches of places, and a stretch's numbers
    meet its cases as matrices; see ``drawn_weights``.
    """
    sums = [c for c in cases.columns if c != ordinal]
    spark = cases.sparkSession
    n, *whole = cases.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in sums]).first()
    out = ", ".join(f"`{c}` long" for c in ["_i", *sums])
    total = spark.createDataFrame([(-1, *whole)], out)
    if n:
        size = max(1, min(n, WEIGHTS // max(1, iterations)))

        def summed(draws: pa.Table, rows: pa.Table) -> pa.Table:
            made = np.zeros((iterations, len(sums)), np.int64)
            if len(draws) and len(rows):
                values = np.zeros((size, len(sums)), np.int64)
                np.add.at(values, rows.column("_place").to_numpy(), np.column_stack([rows.column(f"_{k}").to_numpy() for k in range(len(sums))]))
                # Doubles are exact below 2^53, and faster.
                kind = np.float64 if np.abs(values.astype(np.float64)).max() * n < 2**53 else np.int64
                times = np.zeros((iterations, size), kind)
                for i, weights, more in zip(*(draws.column(c).to_pylist() for c in ("_i", "weights", "more"))):
                    times[i, : len(weights)] = np.frombuffer(weights, np.uint8)
                    np.add.at(times[i], np.array(more, np.int64), 1)
                made += (times @ values.astype(kind)).astype(np.int64)
            return pa.table([pa.array(np.arange(iterations)), *map(pa.array, made.T.copy())], names=["_i", *sums])

        place = F.col(ordinal).cast("long")
        rows = cases.where(place.between(0, n - 1)).select(F.floor(place / size).cast("long").alias("_part"), (place % size).alias("_place"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"_{k}") for k, c in enumerate(sums)])
        sampled = drawn_weights(spark, iterations, n, size).groupBy("_part").cogroup(rows.groupBy("_part")).applyInArrow(summed, out)
        total = total.unionByName(sampled.groupBy("_i").agg(*[F.sum(c).alias(c) for c in sums]))
    rows = total.select("_i", *[m.alias(name) for name, m in metrics.items()]).unpivot(["_i"], list(metrics), "metric", "_v")
    own = rows.groupBy("metric").agg(F.max(F.when(F.col("_i") < 0, F.col("_v"))).alias("value"), F.array_sort(F.collect_list(F.when(F.col("_i") >= 0, F.col("_v")))).alias("_s"))
    at = lambda p: F.get("_s", F.floor(F.lit(p) * (F.size("_s") - 1)).cast("int"))
    return own.select("metric", "value", F.least("value", at(0.025)).alias("ci_low"), F.greatest("value", at(0.975)).alias("ci_high"))


def benchmark_metrics() -> dict[str, Column]:
    """The metrics of extraction and findings over sums of tp, fp, fn, missing, hallucinated, expected, predicted,
    and for each outcome tp_, fp_ and fn_ (in small letters)."""
    c = F.col
    f1 = lambda tp, fp, fn: ratio(2 * tp, 2 * tp + fp + fn)
    rest = [o.lower() for o in OUTCOMES if o != "FAIL"]
    negatives = sum((c(f"tp_{o}") + c(f"fn_{o}") for o in rest), F.lit(0))
    return {
        "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "f1": f1(c("tp"), c("fp"), c("fn")),
        "missing_rate": ratio(c("missing"), c("expected")), "hallucination_rate": ratio(c("hallucinated"), c("predicted")),
        "sensitivity": ratio(c("tp_fail"), c("tp_fail") + c("fn_fail")), "specificity": ratio(negatives - c("fp_fail"), negatives), "false_negative_rate": ratio(c("fn_fail"), c("tp_fail") + c("fn_fail")),
        "macro_f1": sum((f1(c(f"tp_{o.lower()}"), c(f"fp_{o.lower()}"), c(f"fn_{o.lower()}")) for o in OUTCOMES), F.lit(0.0)) / len(OUTCOMES),
    }


def benchmark_counts(outcomes: DataFrame, expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """A row of counts for each case of ``outcomes`` (case_id, ordinal, expected, predicted; no prediction is REVIEW),
    as ``benchmark_metrics`` sums them."""
    got = F.coalesce("predicted", F.lit("REVIEW"))
    labels = [x for o in OUTCOMES for x in (
        ((F.col("expected") == o) & (got == o)).cast("int").alias(f"tp_{o.lower()}"), ((F.col("expected") != o) & (got == o)).cast("int").alias(f"fp_{o.lower()}"), ((F.col("expected") == o) & (got != o)).cast("int").alias(f"fn_{o.lower()}"))]
    counts = extraction_counts(expected, predicted, "case_id")
    rows = outcomes.select("case_id", "ordinal", *labels).join(counts, "case_id", "left").drop("case_id")
    return rows.fillna(0)


def pipeline_report(cases: DataFrame) -> DataFrame:
    return cases.agg(*[F.count_if(F.col("predicted") == o).alias(o.lower()) for o in OUTCOMES], F.count_if(F.col("expected") == F.col("predicted")).alias("matched"), ratio(F.count_if(F.col("predicted") == "REVIEW"), F.count("*")).alias("review_rate"))


def reliability_bins(observations: DataFrame, n: int, *by: str) -> DataFrame:
    """``n`` bins of equal width over [0, 1], the last one closed; empty bins have zeros."""
    edges = [i / n for i in range(1, n)]
    place = sum((F.when(F.col("score") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    used = observations.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    groups = observations.select(*by).distinct() if by else observations.sparkSession.range(1).select()
    every = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return every.join(used, [*by, "bin"], "left").select(*by, "bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "mean_score", "accuracy")])


#: Blocks of scores between 0 and 1 whose sums are carried forward.
SCORE_BLOCKS = 4096


def risk_coverage(observations: DataFrame, *by: str) -> DataFrame:
    """For each distinct score, from the top: the share of observations at or above it, their error
    rate and number.  Scores are summed up first, so windows see one row for each.  No observations at
    all give one point without coverage, at threshold 1 and risk 1, unless there are groups."""
    per = observations.groupBy(*by, "score").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong")).withColumn("_block", F.floor(F.col("score") * SCORE_BLOCKS))
    # Sums of blocks of scores are carried forward, so that no task orders all scores.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = group.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy(*by, "_block").agg(F.sum("n").alias("_n"), F.sum("wrong").alias("_wrong"))
    carried = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    blocks = blocks.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_block").alias("_same"), carried("_n").alias("_count"), carried("_wrong").alias("_bad"), F.sum("_n").over(group).alias("all"))
    same = [F.col("_block").eqNullSafe(F.col("_same")), *[F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]]
    run = Window.partitionBy(*by, "_block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = per.join(blocks, same).withColumns({"count": F.col("_count") + F.sum("n").over(run), "bad": F.col("_bad") + F.sum("wrong").over(run)})
    curve = rows.select(*by, F.col("score").alias("threshold"), (F.col("count") / F.col("all")).alias("coverage"), (F.col("bad") / F.col("count")).alias("risk"), "count")
    if by:
        return curve
    nothing = per.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1.0).alias("threshold"), F.lit(0.0).alias("coverage"), F.lit(1.0).alias("risk"), F.col("n").alias("count"))
    return curve.unionByName(nothing)


def choose_threshold(curve: DataFrame, max_risk: float, min_samples: int, *by: str) -> DataFrame:
    """The threshold of most coverage within the risk, ties to the lower one; none under too few samples."""
    fits = curve.where((F.col("count") >= min_samples) & (F.col("risk") <= max_risk))
    return fits.groupBy(*by).agg(F.max_by("threshold", F.struct("coverage", -F.col("threshold"))).alias("threshold"), F.max("coverage").alias("coverage"))


def apply_calibration(rows: DataFrame, has_profile: Column, samples: Column, min_samples: int, threshold: Column) -> DataFrame:
    """Adds ``decision``: the first reason against it, else ALLOW."""
    decision = (
        F.when(~has_profile, "NO_PROFILE").when((samples < min_samples) | threshold.isNull(), "INSUFFICIENT_SAMPLES")
        .when((F.col("proposed_outcome") == "PASS") & F.col("risk_level").isin("HIGH", "CRITICAL"), "HIGH_RISK_PASS_BLOCKED")
        .when(F.col("score") < threshold, "BELOW_THRESHOLD").otherwise("ALLOW")
    )
    return rows.withColumn("decision", decision)


def impact(baseline: DataFrame, candidate: DataFrame, *by: str) -> DataFrame:
    """Labels of a changed version for each case: they may be several."""
    b, c = baseline.select(*by, F.col("outcome").alias("before")), candidate.select(*by, F.col("outcome").alias("after"))
    rows = b.join(c, list(by))
    labels = F.filter(F.array(
        F.when(F.col("before") != F.col("after"), "OUTCOME_CHANGED"), F.when((F.col("after") == "REVIEW") & (F.col("before") != "REVIEW"), "NEW_REVIEW"),
        F.when(F.col("before").isin("FAIL", "REVIEW") & F.col("after").isin("PASS", "NOT_APPLICABLE"), "POSSIBLE_FALSE_CONFORMITY"), F.when(F.col("before") == F.col("after"), "UNCHANGED"),
    ), lambda x: x.isNotNull())
    return rows.select(*by, "before", "after", labels.alias("labels"))


def impact_summary(impacts: DataFrame) -> DataFrame:
    has = lambda x: F.count_if(F.array_contains("labels", x))
    return impacts.agg(F.count("*").alias("total"), has("OUTCOME_CHANGED").alias("changed"), has("NEW_REVIEW").alias("new_review"), has("POSSIBLE_FALSE_CONFORMITY").alias("possible_false_conformity"), has("UNCHANGED").alias("unchanged"))


def collection_counts(items: DataFrame, expected: DataFrame, collection: str, declared: DataFrame | None = None) -> DataFrame:
    """Items found against the number expected, for each collection; no expectation always matches.

    ``declared`` has the number that each source row of a collection declares.  Their sum must match, too; it is
    null, and does not match, where a source declares none or a negative number, or no source is there.
    """
    n = items.groupBy(collection).agg(F.count("*").alias("found"))
    found = F.coalesce("found", F.lit(0))
    rows = expected.join(n, collection, "left").select(collection, "expected", found.alias("found"), F.coalesce(found == F.col("expected"), F.lit(True)).alias("matches"))
    if declared is None:
        return rows
    sums = declared.groupBy(collection).agg(F.when(F.min(F.coalesce("declared", F.lit(-1))) >= 0, F.sum("declared")).alias("declared"))
    return rows.join(sums, collection, "left").withColumn("declared_matches", F.coalesce(F.col("declared") == F.col("found"), F.lit(False)))


def duplicate_ids(items: DataFrame, *by: str) -> DataFrame:
    """One issue for each occurrence of an id beyond its first, and for each null id."""
    n = items.groupBy(*by).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for c in by:
        null = null | F.col(c).isNull()
    return n.select(*by, F.when(null, F.col("n")).otherwise(F.col("n") - 1).alias("issues")).where("issues > 0")


def relationship_check(source: DataFrame, reference: str, target: DataFrame, key: str, *by: str) -> DataFrame:
    """Total, resolved and missing references."""
    known = target.select(F.col(key).alias(reference)).distinct().withColumn("_known", F.lit(True))
    return source.join(known, reference, "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("_known").alias("resolved"), (F.count("*") - F.count("_known")).alias("missing"))


def missing_references(source: DataFrame, reference: str, target: DataFrame, key: str) -> DataFrame:
    return source.join(target.select(F.col(key).alias(reference)), reference, "left_anti")


def completeness(items: DataFrame, predicates: dict[str, tuple[Column, Column]], *by: str) -> DataFrame:
    """COMPLETE, MISSING and INVALID counts by field; a predicate is (is present, is valid)."""
    parts = []
    for name, (present, valid) in predicates.items():
        state = F.when(~F.coalesce(present, F.lit(False)), "MISSING").when(~F.coalesce(valid, F.lit(False)), "INVALID").otherwise("COMPLETE")
        parts.append(F.struct(F.lit(name).alias("field"), state.alias("state")))
    return items.select(*by, F.explode(F.array(*parts)).alias("x")).groupBy(*by, "x.field", "x.state").agg(F.count("*").alias("n"))


def map_outcomes(rows: DataFrame, label: str, mapping: dict[str, str]) -> DataFrame:
    """Outcome of a source label; labels that are not mapped are REVIEW and flagged."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, F.col(label))
    return rows.withColumns({"outcome": F.coalesce(found, F.lit("REVIEW")), "unmapped": found.isNull()})


def observations(cases: DataFrame, predictions: DataFrame, case: str = "case_id") -> DataFrame:
    """Whether each case's prediction is right; a missing prediction proposes REVIEW."""
    rows = cases.join(predictions, case, "left")
    proposed = F.coalesce("predicted", F.lit("REVIEW"))
    return rows.select(case, "split", "score", (proposed == F.col("expected")).alias("correct"), proposed.alias("proposed_outcome"), "risk_level")


def fit_profile(observations_: DataFrame, max_risk: float, min_samples: int, *by: str) -> DataFrame:
    """Samples and threshold of each group, from its calibration split; no threshold under too few samples."""
    rows = observations_.where("split = 'calibration'")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("samples"))
    chosen = choose_threshold(risk_coverage(rows, *by), max_risk, min_samples, *by).select(*by, "threshold")
    return sizes.join(chosen, list(by), "left")


def select_profile(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(request_id, profile_id)``: the first profile of the request's fact key if it can be used, else
    the first without a key if that can, else none.  Only the first of each tier counts."""
    w = Window.partitionBy("model", "fact_key").orderBy("ordinal")
    first = profiles.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    own = first.where("fact_key is not null").select("model", "fact_key", F.when(F.col("usable"), F.col("profile_id")).alias("own"))
    any_ = first.where("fact_key is null").select("model", F.when(F.col("usable"), F.col("profile_id")).alias("any"))
    return requests.join(own, ["model", "fact_key"], "left").join(any_, "model", "left").select("request_id", F.coalesce("own", "any").alias("profile_id"))


def gate(results: DataFrame, missing: DataFrame, *by: str) -> DataFrame:
    """Whether all tests of a version pass and no coverage is missing, with the numbers of both."""
    r = results.groupBy(*by).agg(F.count_if(~F.col("passed")).alias("failures"))
    m = missing.groupBy(*by).agg(F.count("*").alias("missing"))
    rows = r.join(m, list(by), "full_outer").select(*by, F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("missing", F.lit(0)).alias("missing"))
    return rows.withColumn("ready", (F.col("failures") == 0) & (F.col("missing") == 0))


def coverage(rules: DataFrame, required: list[str], results: DataFrame) -> DataFrame:
    """``(rule_id, tag)`` of required tags that no passed test of the rule has; ``results``: rule_id, tags, passed."""
    wanted = rules.select("rule_id", F.explode(F.array(*map(F.lit, required))).alias("tag"))
    seen = results.where("passed").select("rule_id", F.explode("tags").alias("tag")).distinct()
    return wanted.join(seen, ["rule_id", "tag"], "left_anti")


def audit_summary(files: DataFrame) -> DataFrame:
    """Files, bytes, numbers by severity, and a hash of all content in the order of paths.  Hashes are
    joined within 256 groups of paths first, so the last step sees 256 rows."""
    group = F.substring(F.sha2("path", 256), 1, 2)
    part = files.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content_sha"))), lambda x: x["content_sha"]), ""), 256).alias("h"))
    whole = part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("corpus_sha"))
    sums = files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("VALID", "WARNING", "ERROR")])
    return sums.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").drop("_k")


def budget_check(files: DataFrame, max_bytes: int, *by: str, max_files: int, max_total: int) -> DataFrame:
    """``(by, code, n)``: files over their limit, and groups with too many files or bytes."""
    sums = files.groupBy(*by).agg(F.count_if(F.col("bytes") > max_bytes).alias("large"), F.count("*").alias("files"), F.sum("bytes").alias("total"))
    codes = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), n.cast("long").alias("n"))) for code, c, n in (
        ("FILE_TOO_LARGE", F.col("large") > 0, F.col("large")), ("TOO_MANY_FILES", F.col("files") > max_files, F.col("files")), ("TOO_MANY_BYTES", F.col("total") > max_total, F.col("total")),
    )]))
    return sums.select(*by, F.explode(codes).alias("c")).select(*by, "c.*")


def stale_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, code)`` of sources marked stale, and of those whose file does not exist."""
    marked = sources.where("stale")
    gone = marked.join(files.select("path"), "path", "left_anti").select("path", F.lit("STALE_FILE_MISSING").alias("code"))
    return marked.select("path", F.lit("STALE_SOURCE").alias("code")).unionByName(gone)
