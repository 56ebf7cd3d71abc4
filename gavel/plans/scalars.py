"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geometry, hashing, json_values, numbers, rules, text
from .registry import query

#: Unicode White_Space as a class of RE2; fixed values.
WS = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(c: str) -> str:
    return f"lower(trim(regexp_replace(nfc_normalize({c}), '{WS}+', ' ', 'g'), ' ' || chr(65279)))"



@query("sc1_normalize_text", f"SELECT doc_id, sha256({norm('text')}) AS norm_sha FROM documents")
def sc1(t):
    return t.documents.select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("norm_sha"))


@query("sc2_compare_text", f"SELECT doc_id, CAST(CASE WHEN {norm('lang')} < {norm('source')} THEN -1 WHEN {norm('lang')} = {norm('source')} THEN 0 ELSE 1 END AS INTEGER) AS cmp, CAST(CASE WHEN text < lang THEN -1 WHEN text = lang THEN 0 ELSE 1 END AS INTEGER) AS cmp_raw FROM documents")
def sc2(t):
    n = text.normalize_text
    return t.documents.select("doc_id", text.compare(n(F.col("lang")), n(F.col("source"))).alias("cmp"), text.compare(F.col("text"), F.col("lang")).alias("cmp_raw"))


@query("sc3_text_contains", f"SELECT doc_id, contains({norm('text')}, 'license') AS has, {norm('lang')} = 'en' AS is_en FROM documents")
def sc3(t):
    return t.documents.select("doc_id", text.text_contains(F.col("text"), F.lit(" LICENSE ")).alias("has"), text.text_equals(F.col("lang"), F.lit("EN ")).alias("is_en"))


@query("sc4_valid_number", """SELECT o_orderkey, abs(x) <= 9007199254740991 OR x <> floor(x) AS valid, CAST(CASE WHEN x < 100000 THEN -1 WHEN x = 100000 THEN 0 ELSE 1 END AS INTEGER) AS cmp,
  abs(x * 1e12) <= 9007199254740991 OR x * 1e12 <> floor(x * 1e12) AS big_valid, NOT (x * 0 = 0) AS zero_valid FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS x FROM orders)""")
def sc4(t):
    x = F.col("o_totalprice").cast("double")
    return t.orders.select("o_orderkey", numbers.valid_number(x).alias("valid"), numbers.compare_number(x, F.lit(100000.0)).alias("cmp"), numbers.valid_number(x * 1e12).alias("big_valid"), numbers.valid_number(x * -0.0).alias("zero_valid"))


@query("sc5_number_between", """SELECT o_orderkey, x BETWEEN 50000 AND 200000 AS closed, x > 50000 AND x < 200000 AS open, CAST(NULL AS BOOLEAN) AS reversed FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)""")
def sc5(t):
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", numbers.between(x, 50000, 200000).alias("closed"), numbers.between(x, 50000, 200000, False, False).alias("open"), numbers.between(x, 2, 1).alias("reversed"))


@query("sc6_valid_iso_date", """SELECT o_orderkey, d, try_cast(d AS DATE) IS NOT NULL AND d LIKE '____-__-__' AS valid, CASE WHEN try_cast(d AS DATE) IS NOT NULL AND d LIKE '____-__-__' THEN CAST(CASE WHEN d < '1995-06-15' THEN -1 WHEN d = '1995-06-15' THEN 0 ELSE 1 END AS INTEGER) END AS cmp
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '1995-02-30' WHEN o_orderkey % 7 = 0 THEN '1995-6-1' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)""")
def sc6(t):
    k = F.col("o_orderkey")
    d = F.when(k % 5 == 0, "1995-02-30").when(k % 7 == 0, "1995-6-1").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", d.alias("d")).select("o_orderkey", "d", dates.valid_iso_date(F.col("d")).alias("valid"), dates.compare_date(F.col("d"), F.lit("1995-06-15")).alias("cmp"))


@query("sc7_date_between", """SELECT o_orderkey, d >= '1994-01-01' AND d < '1996-01-01' AS inside FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def sc7(t):
    return t.orders.select("o_orderkey", numbers.between(F.date_format("o_orderdate", "yyyy-MM-dd"), "1994-01-01", "1996-01-01", True, False).alias("inside"))


@query("sc8_compare_utc", """SELECT event_id, CAST(CASE WHEN event_id % 4 = 1 THEN -1 WHEN event_id % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS cmp FROM events""")
def sc8(t):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    a = F.concat(base, F.when(k == 0, ".1200000000Z").when(k == 1, ".1200000001Z").when(k == 2, ".13Z").otherwise("Z"))
    b = F.concat(base, F.when(k == 0, ".12Z").when(k == 1, ".12000000011Z").when(k == 2, ".1299999999999Z").otherwise(".000Z"))
    return t.events.select("event_id", dates.compare_utc(a, b).alias("cmp"))


@query("sc9_in_interval", """SELECT o_orderkey, d >= '1993-01-01' AND d < '1996-01-01' AS bounded, d >= '1993-01-01' AS from_on, d < '1996-01-01' AS until FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def sc9(t):
    d, none = F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("string")
    return t.orders.select("o_orderkey", dates.in_interval(d, F.lit("1993-01-01"), F.lit("1996-01-01")).alias("bounded"), dates.in_interval(d, F.lit("1993-01-01"), none).alias("from_on"), dates.in_interval(d, none, F.lit("1996-01-01")).alias("until"))


@query("sc10_intervals_overlap", """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate < TIMESTAMP '1995-06-01' AND l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1995-01-01' AS hit, l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1995-01-01' AS hit_open FROM lineitem""")
def sc10(t):
    s = F.col("l_shipdate").cast("timestamp_ntz")
    e = s + F.expr("INTERVAL 30 DAY")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", dates.overlap(s, e, at("1995-01-01"), at("1995-06-01")).alias("hit"), dates.overlap(s, e, at("1995-01-01"), at(None)).alias("hit_open"))


BOXES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 80) / 100.0::DOUBLE AS x, (l_suppkey % 80) / 100.0::DOUBLE AS y, (l_partkey % 30) / 100.0::DOUBLE AS x2, (l_suppkey % 30) / 100.0::DOUBLE AS y2 FROM lineitem)"""


def boxes(t):
    part = lambda c, m: (F.col(c) % m) / F.lit(100.0)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", part("l_partkey", 80).alias("x"), part("l_suppkey", 80).alias("y"), part("l_partkey", 30).alias("x2"), part("l_suppkey", 30).alias("y2"))
    size = F.lit(0.1)
    return rows, geometry.box(F.col("x"), F.col("y"), size, size), geometry.box(F.col("x2"), F.col("y2"), F.lit(0.2), F.lit(0.2))


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
W, H = "greatest(0, least(x + 0.1, x2 + 0.2) - greatest(x, x2))", "greatest(0, least(y + 0.1, y2 + 0.2) - greatest(y, y2))"
GAP = "sqrt(pow(greatest(0, x - (x2 + 0.2), x2 - (x + 0.1)), 2) + pow(greatest(0, y - (y2 + 0.2), y2 - (y + 0.1)), 2)) / sqrt(2.0)"


@query("sc11_bbox_iou", f"SELECT {KEYS}, round(w * h / (0.01 + 0.04 - w * h), 6) AS iou FROM (SELECT *, CAST({W} AS DOUBLE) AS w, CAST({H} AS DOUBLE) AS h FROM {BOXES})")
def sc11(t):
    rows, a, b = boxes(t)
    return rows.select(*KEYS.split(", "), F.round(geometry.bbox_iou(a, b), 6).alias("iou"))


@query("sc12_bbox_edge_distance", f"SELECT {KEYS}, round({GAP}, 6) AS gap FROM {BOXES}")
def sc12(t):
    rows, a, b = boxes(t)
    return rows.select(*KEYS.split(", "), F.round(geometry.bbox_edge_distance(a, b), 6).alias("gap"))


@query("sc13_same_area", f"SELECT {KEYS}, l_suppkey % 7 = 3 AND l_linenumber % 3 = 1 AND {GAP} <= 0.30001 AS same FROM {BOXES}")
def sc13(t):
    rows, a, b = boxes(t)
    region = lambda d, p, x: F.struct(d.alias("document_id"), F.lit("h").alias("document_hash"), p.alias("page"), x.alias("box"))
    return rows.select(*KEYS.split(", "), geometry.same_area(region(F.col("l_suppkey") % 7, 1 + F.col("l_linenumber") % 3, a), region(F.lit(3), F.lit(2), b), 0.30001).alias("same"))


@query("sc14_valid_bbox", f"SELECT {KEYS}, x + s <= 1 AND y + s <= 1 AS ok, x2 > x AND y2 > y AS ok_corners FROM (SELECT *, (l_partkey % 40) / 100.0::DOUBLE + 0.001 AS s FROM {BOXES})")
def sc14(t):
    rows, _, _ = boxes(t)
    s = (F.col("l_partkey") % 40) / F.lit(100.0) + 0.001
    return rows.select(*KEYS.split(", "), geometry.valid_bbox(geometry.box(F.col("x"), F.col("y"), s, s)).alias("ok"), geometry.valid_xyxy(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("ok_corners"))


@query("sc15_normalize_unicode")
def sc15(t):
    return t.documents.select("doc_id", F.sha2(text.normalize_unicode(F.col("text")), 256).alias("norm_sha"))


@query("sc16_normalize_decimal", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN -CAST(o_orderkey AS DOUBLE) WHEN o_orderkey % 4 = 2 THEN NULL ELSE 0.0 END AS v FROM orders""")
def sc16(t):
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("0"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string"), F.lit(".00"))).when(k % 4 == 2, F.concat(F.lit("9007199254740993"))).otherwise("-0")
    return t.orders.select("o_orderkey", s.alias("s")).select("o_orderkey", numbers.normalize_decimal(F.col("s")).alias("v"))


@query("sc17_normalize_utc", """SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '.120Z' AS utc, strftime(ts, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS bad FROM events""")
def sc17(t):
    s = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".12+02:00"))
    return t.events.select("event_id", dates.normalize_utc_datetime(s).alias("utc"), dates.normalize_iso_date(F.date_format("ts", "yyyy-MM-dd")).alias("day"), dates.normalize_utc_datetime(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("bad"))


@query("sc18_canonical_json", """SELECT event_id, '{"a":[1,0.5,null],"k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def sc18(t):
    j = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit('.0, "a": [1.0, 5e-1, null] }'))
    return t.events.select("event_id", hashing.canonical_json(j).alias("canonical"))


@query("sc19_content_hash", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","nothing":null,"tags":["a|b","null"],"user_id":' || user_id || '}') AS h FROM events""")
def sc19(t):
    rows = t.events.withColumns({"nothing": F.lit(None).cast("string"), "tags": F.array(F.lit("a|b"), F.lit("null"))})
    return rows.select("event_id", hashing.content_hash("event_id", "user_id", "event_type", "nothing", "tags").alias("h"))


@query("sc20_bounded_value", "SELECT doc_id, CASE WHEN strlen(text) <= 512 THEN text END AS value, CASE WHEN strlen(text) > 512 THEN sha256(text) END AS sha256, CASE WHEN strlen(text) > 512 THEN CAST(strlen(text) AS BIGINT) END AS bytes, CASE WHEN strlen(text) > 512 THEN CAST(length(text) AS BIGINT) END AS units FROM documents")
def sc20(t):
    return t.documents.select("doc_id", hashing.bounded_value(F.col("text")).alias("b")).select("doc_id", "b.*")


@query("sc21_json_pointer", """SELECT event_id, true AS found, json_extract_string(props, '$.k') AS v, false AS absent, event_id % 2 = 0 AS null_found, CAST(NULL AS VARCHAR) AS null_value, 'x' AS nested FROM events""")
def sc21(t):
    j = F.concat(F.lit('{"p":'), F.col("props"), F.when(F.col("event_id") % 2 == 0, ',"n":null').otherwise(""), F.lit(',"a/b":[1,{"~":"x"}]}'))
    rows = t.events.select("event_id", j.alias("j"))
    p = lambda pointer: json_values.json_pointer(F.col("j"), pointer)
    return rows.select("event_id", p("/p/k")["found"].alias("found"), p("/p/k")["value"].alias("v"), p("/zz")["found"].alias("absent"), p("/n")["found"].alias("null_found"), p("/n")["value"].alias("null_value"), p("/a~1b/1/~0")["value"].alias("nested"))


@query("sc22_language_matches", "SELECT doc_id, lang = 'en' AS exact, lang IN ('en') AS main FROM documents")
def sc22(t):
    return t.documents.select("doc_id", text.language_matches(F.upper("lang"), F.lit("en")).alias("exact"), text.language_matches(F.concat("lang", F.lit("-GB")), F.lit("EN-us"), "PRIMARY").alias("main"))


@query("sc23_compare_semver", """SELECT o_orderkey, CAST(CASE WHEN a < 10 THEN -1 WHEN a > 10 THEN 1 WHEN k % 3 = 0 THEN 0 ELSE -1 END AS INTEGER) AS cmp, CAST(CASE WHEN k % 20 < 7 THEN -1 WHEN k % 20 = 7 THEN 0 ELSE 1 END AS INTEGER) AS pre_cmp, CAST(NULL AS INTEGER) AS bad FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 25 AS a FROM orders)""")
def sc23(t):
    k = F.col("o_orderkey")
    a = F.concat(F.lit("1."), (k % 25).cast("string"), F.lit(".0"), F.when(k % 3 == 0, "+build.1").otherwise("-rc.1"))
    pre = F.concat(F.lit("2.0.0-rc."), (k % 20).cast("string"))
    return t.orders.select("o_orderkey", rules.compare_semver(a, F.lit("1.10.0")).alias("cmp"), rules.compare_semver(pre, F.lit("2.0.0-rc.7")).alias("pre_cmp"), rules.compare_semver(F.lit("1.02.0"), F.lit("1.0.0")).alias("bad"))


TRUTH = "(SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE (o_orderkey // 3) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b, CASE (o_orderkey // 9) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c FROM orders)"


def truths(t):
    three = lambda n: F.when(F.floor(F.col("o_orderkey") / n) % 3 == 0, True).when(F.floor(F.col("o_orderkey") / n) % 3 == 1, False)
    return t.orders.select("o_orderkey", three(1).alias("a"), three(3).alias("b"), three(9).alias("c"))


@query("sc24_kleene", f"SELECT o_orderkey, NOT a AS n, a AND b AND c AS x, a OR b OR c AS y FROM {TRUTH}")
def sc24(t):
    a, b, c = map(F.col, "abc")
    return truths(t).select("o_orderkey", rules.kleene_not(a).alias("n"), rules.kleene_and(a, b, c).alias("x"), rules.kleene_or(a, b, c).alias("y"))


@query("sc25_derive_outcome", f"SELECT o_orderkey, CASE WHEN a IS NULL THEN 'REVIEW' WHEN NOT a THEN 'NOT_APPLICABLE' WHEN b IS NULL THEN 'REVIEW' WHEN b THEN 'NOT_APPLICABLE' WHEN c IS NULL THEN 'REVIEW' WHEN c THEN 'PASS' ELSE 'FAIL' END AS outcome FROM {TRUTH}")
def sc25(t):
    return truths(t).select("o_orderkey", rules.derive_outcome(F.col("a"), F.col("b"), F.col("c")).alias("outcome"))


@query("sc26_effective_risk", """SELECT o_orderkey, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[greatest(o_orderkey % 4, o_orderkey // 4 % 3) + 1] AS risk, CAST(CASE WHEN greatest(o_orderkey % 4, o_orderkey // 4 % 3) >= 2 THEN 2 ELSE 1 END AS INTEGER) AS approvals FROM orders""")
def sc26(t):
    name = lambda c: F.element_at(F.array(*map(F.lit, rules.RISKS)), c.cast("int") + 1)
    risk = rules.effective_risk(name(F.col("o_orderkey") % 4), name(F.floor(F.col("o_orderkey") / 4) % 3))
    return t.orders.select("o_orderkey", risk.alias("risk"), rules.approvals_needed(risk).alias("approvals"))


STATES = ["UPLOADED", "REVIEWED", "APPROVED", "RETIRED"]


@query("sc27_valid_transition", """SELECT event_id, coalesce((b IS NULL AND a = 'UPLOADED' AND r = 'AUTHOR') OR (b = 'UPLOADED' AND a = 'REVIEWED' AND r = 'REVIEWER' AND ind) OR (b = 'REVIEWED' AND a = 'APPROVED' AND r = 'APPROVER' AND ind) OR (b = 'APPROVED' AND a = 'RETIRED' AND r = 'APPROVER' AND ind AND why), false) AS ok
 FROM (SELECT event_id, (['UPLOADED', 'REVIEWED', 'APPROVED', 'RETIRED'])[event_id % 5] AS b, (['UPLOADED', 'REVIEWED', 'APPROVED', 'RETIRED'])[event_id // 5 % 4 + 1] AS a, (['AUTHOR', 'REVIEWER', 'APPROVER'])[event_id // 20 % 3 + 1] AS r, user_id % 2 = 0 AS ind, user_id % 3 = 0 AS why FROM events)
""")
def sc27(t):
    at = lambda names, c: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    before = F.when(e % 5 > 0, at(STATES, e % 5 - 1))
    return t.events.select("event_id", F.coalesce(rules.valid_transition(rules.SOURCE_MOVES, before, at(STATES, F.floor(e / 5) % 4), at(["AUTHOR", "REVIEWER", "APPROVER"], F.floor(e / 20) % 3), u % 2 == 0, F.when(u % 3 == 0, "why").otherwise(" ")), F.lit(False)).alias("ok"))


@query("sc28_citation", r"SELECT doc_id, CASE WHEN length(text) <= 280 THEN text ELSE regexp_replace(substr(text, 1, 277), '\s+$', '') || '…' END AS citation FROM documents")
def sc28(t):
    return t.documents.select("doc_id", text.citation(F.col("text")).alias("citation"))


@query("sc29_bounded_text", "SELECT doc_id, sha256(CASE WHEN units <= 20000 THEN text ELSE substr(text, 1, 20000 - length(note)) || note END) AS h FROM (SELECT *, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units, chr(10) || '...[truncated; sha256=' || sha256(text) || '; originalCharacters=' || (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) || ']' AS note FROM documents)")
def sc29(t):
    return t.documents.select("doc_id", F.sha2(text.bounded_text(F.col("text")), 256).alias("h"))


@query("sc30_fingerprints", "SELECT doc_id, sha256(lower(source)) AS token, substr(sha256('SECRET' || chr(0) || lang || chr(0) || source || chr(0) || doc_id), 1, 16) AS finding FROM documents")
def sc30(t):
    return t.documents.select("doc_id", hashing.token_hash(F.upper("source")).alias("token"), hashing.finding_fingerprint(F.lit("SECRET"), F.col("lang"), F.col("source"), F.col("doc_id")).alias("finding"))


@query("sc31_deterministic_uuid", "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)")
def sc31(t):
    return t.documents.select("doc_id", hashing.deterministic_uuid(F.col("doc_id").cast("string")).alias("uuid"))


@query("sc32_safe_reference", r"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'base/' || lang || '/' || doc_id || '.json' END AS ref FROM documents")
def sc32(t):
    k = F.col("doc_id")
    tail = F.concat("lang", F.lit("/"), k.cast("string"), F.lit(".json"))
    value = F.when(k % 5 == 0, F.concat(F.lit("/"), tail)).when(k % 5 == 1, F.concat(F.lit("a/../"), tail)).when(k % 5 == 2, F.concat(F.lit("a\\"), tail)).when(k % 5 == 3, F.concat(F.lit("./"), tail)).otherwise(tail)
    return t.documents.select("doc_id", text.safe_reference(value, F.lit("base")).alias("ref"))


@query("sc33_is_non_empty", """SELECT event_id, (event_id % 7) IN (0, 2, 4) AS ok FROM events""")
def sc33(t):
    k = F.col("event_id") % 7
    j = F.when(k == 0, F.col("props")).when(k == 1, "{}").when(k == 2, "[1]").when(k == 3, "[]").when(k == 4, '"x"').when(k == 5, '"  "').otherwise("7")
    return t.events.select("event_id", j.alias("j")).select("event_id", json_values.is_non_empty(F.col("j")).alias("ok"))
