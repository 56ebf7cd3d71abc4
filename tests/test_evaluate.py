"""Rule evaluation on inputs that the test tables do not hold."""

from gavel.operators import evaluate, resolution

FACTS = "case_id long, fact_id string, fact_key string, value_type string, status string, v_string string, v_number double, v_boolean boolean, v_date string, v_json string, evidence_ids array<string>, provider_run_id string"
EVIDENCE = "case_id long, evidence_id string, provider_run_id string, language string, document_id long, document_hash string, page int, x double, y double, width double, height double"


def fact(case, fact_id, text):
    return (case, fact_id, "k", "STRING", "RESOLVED", text, None, None, None, None, [], "r")


def test_text_forms_duplicates_and_cases_without_facts(spark):
    facts = spark.createDataFrame([fact(1, "a", "Étude"), fact(2, "b", "  Foo   BAR "), fact(2, "a", "no")], FACTS)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    rules = [
        {"rule_id": "R1", "applies_when": {"op": "truth", "b": True}, "satisfied_when": {"op": "eq", "fact_key": "k", "value_type": "STRING", "s": "étude"}},
        {"rule_id": "R2", "applies_when": {"op": "matches", "fact_key": "k", "pattern": "^(foo bar|no)$"}, "satisfied_when": {"op": "truth", "b": True}, "overrides": {"R1": {"op": "truth", "b": True}}},
    ]
    found = evaluate.evaluate_rules(evaluate.by_case(facts, spark.createDataFrame([], EVIDENCE), cases=cases), rules)
    got = {(r["case_id"], r["rule_id"]): r["outcome"] for r in evaluate.findings(found).collect()}
    assert got == {(1, "R1"): "PASS", (1, "R2"): "NOT_APPLICABLE", (2, "R1"): "FAIL", (2, "R2"): "PASS", (3, "R1"): "REVIEW", (3, "R2"): "REVIEW"}
    rows = resolution.exploded(resolution.resolve_findings(found, resolution.Pack.of(rules))).collect()
    assert {(r["case_id"], r["rule_id"]): r["resolution"] for r in rows} == {(1, "R1"): "UNCHANGED", (1, "R2"): "UNCHANGED", (2, "R1"): "OVERRIDDEN", (2, "R2"): "UNCHANGED", (3, "R1"): "UNCHANGED", (3, "R2"): "UNCHANGED"}


def test_a_pack_with_a_cycle(spark):
    pack = resolution.Pack(["A", "B", "C", "D", "E"], [("A", "B"), ("B", "A"), ("B", "C"), ("D", "E")])
    assert pack.invalid == {"A", "B", "C"} and pack.levels == {"D": 0, "E": 1}
    edges = spark.createDataFrame([(1, *e) for e in pack.edges] + [(2, "D", "E"), (2, "E", "D")], "pack int, source string, target string")
    assert {tuple(r) for r in resolution.override_cycles(edges, "pack").collect()} == {(1, "A"), (1, "B"), (2, "D"), (2, "E")}
    assert {tuple(r) for r in resolution.override_levels(edges, "pack").collect()} == {(1, "D", 0), (1, "E", 1)}
