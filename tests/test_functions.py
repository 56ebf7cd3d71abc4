from pyspark.sql import functions as F

import pytest

from gavel.functions import dates, hashing, rules
from gavel.operators import corpus, evaluate, quality


def test_decision_ladder(spark):
    t, f, u = True, False, None
    rows = [(t, f, t, "PASS"), (t, f, f, "FAIL"), (t, f, u, "REVIEW"), (f, u, u, "NOT_APPLICABLE"), (t, t, u, "NOT_APPLICABLE"), (u, f, t, "REVIEW"), (t, u, t, "REVIEW")]
    df = spark.createDataFrame(rows, "a boolean, e boolean, s boolean, want string")
    assert df.where(rules.derive_outcome(F.col("a"), F.col("e"), F.col("s")) != F.col("want")).count() == 0


def test_kleene_tables(spark):
    values = [True, False, None]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    for row in df.select("a", "b", rules.kleene_and(F.col("a"), F.col("b")).alias("x"), rules.kleene_or(F.col("a"), F.col("b")).alias("y")).collect():
        both = (row.a, row.b)
        assert row.x == (False if False in both else None if None in both else True)
        assert row.y == (True if True in both else None if None in both else False)


def test_patterns(spark):
    cases = [("a$", {}, "a\n", False), ("a$", {}, "ba", True), ("^b", {"multiline": True}, "a\nb", True), ("^$", {"multiline": True}, "a\n", True), ("a.b", {}, "a\nb", False), ("a.b", {"dot_all": True}, "a\nb", True), ("b", {"full": True}, "abc", False), ("[[:alpha:]]+", {"full": True}, "abc", True)]
    for pattern, options, text, want in cases:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(F.col("t").rlike(evaluate.translate_pattern(pattern, **options))).first()[0] == want, pattern


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": [1e21, 0.000001, 1e-7, true, null, "é"]}',), ("nope",), (None,)], "j string")
    got = [r[0] for r in df.select(hashing.canonical_json(F.col("j"))).collect()]
    assert got == ['{"a":[1e+21,0.000001,1e-7,true,null,"é"],"b":1}', None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Pacific/Apia"])
def test_instants_do_not_depend_on_the_zone(spark, zone):
    """Also around a gap and an overlap of New York's clocks."""
    rows = [("2021-03-14T02:30:00Z", "2021-03-14T03:10:00Z", -1), ("2021-11-07T01:30:00.5Z", "2021-11-07T01:30:00.50Z", 0), ("2021-11-07T06:30Z", "2021-11-07T05:30:59Z", 1), ("1965-01-01T00:00:00Z", "no", None)]
    texts = [("2021-03-14T02:30:00.1239+00:00", "2021-03-14T02:30:00.123Z"), ("2021-11-07T01:30:00-05:00", "2021-11-07T06:30:00.000Z"), ("1965-01-01T00:00:00.001Z", "1965-01-01T00:00:00.001Z"), ("2021-13-01T00:00:00Z", None), (None, None)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame(rows, "a string, b string, want int").select(dates.compare_utc(F.col("a"), F.col("b")), "want").collect()
        assert all(x == want for x, want in got)
        got = spark.createDataFrame(texts, "t string, want string").select(dates.normalize_utc_datetime(F.col("t")), "want").collect()
        assert all(x == want for x, want in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_risk_coverage_of_nothing(spark):
    none = spark.createDataFrame([], "score double, correct boolean, kind string")
    assert [tuple(r) for r in quality.risk_coverage(none).collect()] == [(1.0, 0.0, 1.0, 0)]
    assert quality.risk_coverage(none, "kind").count() == 0


def test_content_hashes_tell_rows_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "null"), ("null", None)], "x string, y string")
    assert rows.select(hashing.content_hash("x", "y").alias("h")).distinct().count() == 4


def test_every_match_of_a_line_has_its_column(spark):
    key = "AKIA" + "Z" * 16
    docs = spark.createDataFrame([("a\\secret\\b", f"\U0001f600 {key} x {key}\r\nFoo foo-bar\n  FOO"), ("ok/secret", "none"), (None, None)], "path string, content string")
    banned = docs.sparkSession.range(1).select(hashing.token_hash(F.lit("foo"))).first()[0]
    got = corpus.scan_sensitive(docs, forbidden=[banned], segments=["/secret"], allowed=["ok/secret"])
    assert sorted((r.kind, r.line, r.column) for r in got.collect()) == [("FORBIDDEN_TOKEN", 2, 1), ("FORBIDDEN_TOKEN", 3, 3), ("POTENTIAL_SECRET", 1, 4), ("POTENTIAL_SECRET", 1, 27), ("PRIVATE_PATH", 1, 1)]


@pytest.mark.parametrize("blocks", [1, 3, 4096])
def test_risk_coverage_carries_sums(spark, monkeypatch, blocks):
    monkeypatch.setattr(quality, "SCORE_BLOCKS", blocks)
    rows = [(i * i % 17 / 16, i % 3 > 0, "b" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "score double, correct boolean, kind string")

    def plain(rows):
        for t in {r[0] for r in rows}:
            above = [ok for score, ok, _ in rows if score >= t]
            yield t, len(above) / len(rows), above.count(False) / len(above), len(above)

    assert sorted(tuple(r) for r in quality.risk_coverage(df).collect()) == sorted(plain(rows))
    got = quality.risk_coverage(df, "kind").collect()
    for kind in ("b", None):
        assert sorted(tuple(r)[1:] for r in got if r.kind == kind) == sorted(plain([r for r in rows if r[2] == kind]))
