"""Chunks against a plain version, bootstrap intervals against published ones, sources on odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from gavel.functions import json_values
from gavel.functions import text as texts
from gavel.operators import chunking, quality
from gavel.sources import facts as json_facts
from gavel.sources import files


def plain_chunks(text, longest, overlap):
    """Every place is tried, one after the other; texts of the basic plane."""
    out, start = [], 0
    if len(text) <= longest:
        return [text]
    while start < len(text):
        hard = min(len(text), start + longest)
        end = hard
        if hard < len(text):
            for mark in (". ", "; ", ": ", "\n", " "):
                places = [i for i in range(max(start + 1, hard - 160), hard + 1) if text[i : i + len(mark)] == mark]
                if places:
                    end = places[-1] + len(mark)
                    break
        piece = text[start:end].strip()
        out += [piece] if piece else []
        if end >= len(text):
            break
        start = max(0, end - overlap)
    return out


def test_chunks(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.choice([1, 3, 9, 300]))) + rng.choice(["", ".", ";", ":", ""])
    made = ["", " \t ", "short  text", "x" * 5000] + [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(30)]
    df = spark.createDataFrame([(i, "v", t) for i, t in enumerate(made)] + [(99, "v", None)], "section_id int, version_id string, text string")
    got = {}
    for r in chunking.chunk_text(df, longest=400, overlap=50).orderBy("section_id", "chunk_ordinal").collect():
        got.setdefault(r.section_id, []).append(r.text)
    assert got == {i: plain_chunks(" ".join(t.split()), 400, 50) for i, t in enumerate(made)}


def test_chunks_in_utf16_units():
    pieces = list(chunking.spans("\U0001f600" * 300 + " end", 400, 50))
    assert pieces[0].count("\U0001f600") == 200 and pieces[-1].endswith("end")


@pytest.mark.parametrize("iterations, want", [(50, {"precision": (0.9620, 0.9268, 0.9873), "recall": (0.95, 0.9125, 0.9875), "f1": (0.9560, 0.9308, 0.9809), "missing_rate": (0.05, 0.0125, 0.0875), "hallucination_rate": (0.0380, 0.0127, 0.0714), "sensitivity": (0.6, 0.2, 1.0), "specificity": (1.0, 1.0, 1.0), "macro_f1": (0.8920, 0.75, 1.0), "false_negative_rate": (0.4, 0.0, 0.8)}),
                                               (200, {"precision": (0.9620, 0.9259, 1.0), "recall": (0.95, 0.90, 0.9875), "f1": (0.9560, 0.9290, 0.9814)})])
def test_published_intervals(spark, iterations, want):
    outcomes, expected, predicted = [], [], []
    for i in range(1, 21):
        truth = ["PASS", "FAIL", "REVIEW", "NOT_APPLICABLE"][(i - 1) % 4]
        said = "PASS" if i % 9 == 0 and truth == "FAIL" else "REVIEW" if i % 7 == 0 else truth
        outcomes.append((i, i - 1, truth, said))
        expected += [(i, k, "v") for k in "abcm"]
        predicted += [(i, k, "v") for k in "abcm" if k != "m" or i % 5] + ([(i, "extra", "v")] if i % 6 == 0 else [])
    schema = "case_id int, key string, value string"
    counts = quality.benchmark_counts(spark.createDataFrame(outcomes, "case_id int, ordinal int, expected string, predicted string"), spark.createDataFrame(expected, schema), spark.createDataFrame(predicted, schema))
    got = {r.metric: (r.value, r.ci_low, r.ci_high) for r in quality.bootstrap_ci(counts, quality.benchmark_metrics(), iterations).collect()}
    for metric, values in want.items():
        assert got[metric] == pytest.approx(values, abs=6e-5), metric


def test_draws_follow_the_generator(spark):
    n, want = 1000, []
    for it in range(3):
        state = (42 + it * 2_654_435_761) % 2**32
        for k in range(n):
            state = (state * 1_664_525 + 1_013_904_223) % 2**32
            want.append(state % n)
    rows = spark.range(3 * n).select("id", quality.drawn_case(F.floor(F.col("id") / n).cast("long"), F.col("id") % n, n).alias("c"))
    assert [r.c for r in rows.orderBy("id").collect()] == want


def test_pointers_and_bad_json(spark):
    df = spark.createDataFrame([('{"a":{"0":"m"},"b\'c":[7]}',), ("{} {}",), (None,)], "j string")
    got = [tuple(r) for r in df.select(json_values.json_pointer(F.col("j"), "/a/0").value, json_values.json_pointer(F.col("j"), "/b'c/0").value, json_values.parsed(F.col("j")).isNotNull()).collect()]
    assert got == [("m", "7", True), (None, None, False), (None, None, False)]
    empty = df.limit(0).select(F.lit(1).alias("case_id"), F.col("j").alias("body"))
    facts, evidence = json_facts.facts_from_json(empty, [{"key": "k", "type": "STRING", "pointers": ["/a"]}])
    assert facts.count() == evidence.count() == 0


def test_bounded_text(spark):
    made = ["x" * 20_000, "x" * 20_001, "\U0001f600" * 15_000, "y" + "\U0001f600" * 15_000]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    out = [r[0] for r in df.select(texts.bounded_text(F.col("t"))).collect()]
    units = [len(t.encode("utf-16-le")) // 2 for t in out]
    assert out[0] == made[0] and units[1] == 20_000 and all(19_999 <= u <= 20_000 for u in units) and "originalCharacters=30001]" in out[3]


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe" * 40)
    rows = {r.path.rsplit("/", 1)[1]: (r.detected_format, r.status, list(r.issues)) for r in files.artifact_inventory(files.read_files(spark, str(tmp_path), 64), 64).collect()}
    assert rows == {"a.json": ("JSON", "VALID", []), "b.bin": ("UNKNOWN", "ERROR", ["FILE_TOO_LARGE"])}
