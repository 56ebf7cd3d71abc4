"""A small pack of rules over the facts of orders; it uses every operator of expressions."""

from __future__ import annotations


def leaf(op: str, key: str | None = None, **more) -> dict:
    return {"op": op} | ({"fact_key": key} if key else {}) | more


def all_(*args: dict) -> dict:
    return {"op": "all", "args": list(args)}


def any_(*args: dict) -> dict:
    return {"op": "any", "args": list(args)}


def not_(arg: dict) -> dict:
    return {"op": "not", "args": [arg]}


#: One leaf for each operator, with the SQL of its value (over a row ``f`` of facts) and the type it asks for.
LEAVES = {
    "p1_truth": (leaf("truth", b=True), "true", None),
    "p2_present": (leaf("present", "line.returnflag"), "", None),
    "p3_eq": (leaf("eq", "order.status", value_type="STRING", s=" f "), "lower(trim(f.v_string)) = 'f'", "STRING"),
    "p4_not_eq": (leaf("not_eq", "order.is_large", value_type="BOOLEAN", b=True), "NOT (f.v_boolean = true)", "BOOLEAN"),
    "p5_contains": (leaf("contains", "order.priority", s="URGENT"), "contains(lower(trim(f.v_string)), 'urgent')", "STRING"),
    "p6_contains_any": (leaf("contains_any", "order.priority", many=["high", "low "]), "(contains(lower(trim(f.v_string)), 'high') OR contains(lower(trim(f.v_string)), 'low'))", "STRING"),
    "p7_matches": (leaf("matches", "order.typed_wrong", pattern=r"^[0-9]{5}\.[0-9]+$"), r"regexp_matches(f.v_string, '^[0-9]{5}\.[0-9]+$')", "STRING"),
    "p8_greater_than": (leaf("greater_than", "order.total", n=150000.0), "f.v_number > 150000", "NUMBER"),
    "p9_less_than": (leaf("less_than", "order.typed_wrong", n=150000.0), "f.v_number < 150000", "NUMBER"),
    "p10_between": (leaf("between", "line.max_discount", low=0.05, high=0.09, with_high=False), "f.v_number >= 0.05 AND f.v_number < 0.09", "NUMBER"),
    "p11_date_before": (leaf("date_before", "order.date", s="1995-01-01"), "f.v_date < '1995-01-01'", "DATE"),
    "p12_date_after": (leaf("date_after", "line.last_ship", s="1996-06-30"), "f.v_date > '1996-06-30'", "DATE"),
    "p13_date_between": (leaf("date_between", "line.last_ship", date_low="1994-01-01", date_high="1997-01-01"), "f.v_date BETWEEN '1994-01-01' AND '1997-01-01'", "DATE"),
    "p14_language_present": (leaf("language_present", "order.total", s="EN", mode="PRIMARY"), "len(list_intersect(f.evidence_ids, coalesce(f.english, []))) > 0", None),
}
TOTAL, STATUS, PRIORITY, DATE, LARGE, FLAG, DISCOUNT, SHIP, WRONG = (f"{k}" for k in ("order.total", "order.status", "order.priority", "order.date", "order.is_large", "line.returnflag", "line.max_discount", "line.last_ship", "order.typed_wrong"))


def of(name: str) -> dict:
    return LEAVES[name][0]


#: Rules with overrides (a chain of three and one whose truth is unknown), a declared and a
#: deontic conflict, and two rules that override each other.
RULES = [
    {"rule_id": "R1", "applies_when": of("p11_date_before"), "satisfied_when": all_(of("p8_greater_than"), not_(of("p5_contains"))), "exceptions": {"late": of("p12_date_after")}},
    {"rule_id": "R2", "applies_when": of("p1_truth"), "satisfied_when": any_(of("p3_eq"), of("p6_contains_any")), "overrides": {"R1": of("p4_not_eq")}},
    {"rule_id": "R3", "applies_when": of("p7_matches"), "satisfied_when": of("p10_between"), "overrides": {"R2": of("p10_between")}},
    {"rule_id": "R4", "applies_when": any_(of("p2_present"), of("p8_greater_than")), "satisfied_when": not_(any_(of("p13_date_between"), of("p3_eq"))), "exceptions": {"a": of("p5_contains"), "b": of("p2_present")}},
    {"rule_id": "R5", "applies_when": of("p14_language_present"), "satisfied_when": of("p9_less_than"), "overrides": {"R4": of("p2_present")}},
    {"rule_id": "R6", "applies_when": of("p8_greater_than"), "satisfied_when": all_(of("p6_contains_any"), of("p12_date_after"), of("p1_truth"))},
    {"rule_id": "R7", "applies_when": of("p1_truth"), "satisfied_when": of("p8_greater_than"), "overrides": {"R8": of("p3_eq")}},
    {"rule_id": "R8", "applies_when": of("p1_truth"), "satisfied_when": of("p3_eq"), "overrides": {"R7": of("p3_eq")}},
]
CONFLICTS = [("R2", "R6"), ("R4", "R6")]
NORMS = {"R1": ("n1", "OBLIGATION"), "R2": ("n2", "PERMISSION"), "R3": ("n3", "OBLIGATION"), "R4": ("n4", "OBLIGATION"), "R5": ("n5", "DEFINITION"), "R6": ("n1", "PROHIBITION"), "R7": ("n7", "OBLIGATION"), "R8": ("n8", "OBLIGATION")}


def leaf_sql(name: str) -> str:
    """``(case_id, truth, reason)`` of one leaf."""
    node, value, kind = LEAVES[name]
    key = node.get("fact_key")
    if not key:
        return f"SELECT case_id, {value} AS truth, 'EVALUATED' AS reason FROM cases"
    if node["op"] == "present":
        ladder = """CASE WHEN f.fact_key IS NULL THEN 'MISSING_FACT' WHEN NOT complete THEN 'MISSING_EVIDENCE' WHEN status IN ('RESOLVED', 'NOT_FOUND') AND len(evidence_ids) = 0 THEN 'MISSING_EVIDENCE' WHEN status IN ('RESOLVED', 'NOT_FOUND') THEN 'EVALUATED' ELSE 'UNRESOLVED_FACT' END"""
        value = "f.status = 'RESOLVED'"
    else:
        typed = f"WHEN f.value_type <> '{kind}' THEN 'TYPE_MISMATCH'" if kind else ""
        ladder = f"CASE WHEN f.fact_key IS NULL THEN 'MISSING_FACT' WHEN NOT complete THEN 'MISSING_EVIDENCE' WHEN status <> 'RESOLVED' THEN 'UNRESOLVED_FACT' {typed} ELSE 'EVALUATED' END"
    return f"""SELECT case_id, CASE WHEN reason = 'EVALUATED' THEN truth END AS truth, reason FROM (SELECT cases.case_id, ({value}) AS truth, {ladder} AS reason FROM cases
 LEFT JOIN (SELECT known.*, english FROM known LEFT JOIN (SELECT case_id, list(evidence_id) AS english FROM evidence WHERE language IN ('en', 'en-GB') GROUP BY case_id) USING (case_id) WHERE fact_key = '{key}') f ON f.case_id = cases.case_id)"""


NAME_OF = {id(node): name for name, (node, _, _) in LEAVES.items()}


def node_sql(node: dict) -> str:
    """The truth of a node over a row that has each leaf's truth as a column."""
    if node["op"] == "not":
        return f"NOT ({node_sql(node['args'][0])})"
    if node["op"] in ("all", "any"):
        return "(" + (" AND " if node["op"] == "all" else " OR ").join(node_sql(a) for a in node["args"]) + ")"
    return NAME_OF[id(node)]


def wide_sql() -> str:
    """CTEs up to ``wide``: a row for each case with the truth of all leaves."""
    from .fixtures import SQL_FACTS

    leaves = ", ".join(f"x_{n} AS MATERIALIZED ({leaf_sql(n)})" for n in LEAVES)
    joins = " ".join(f"JOIN (SELECT case_id, truth AS {n}, reason AS r_{n} FROM x_{n}) USING (case_id)" for n in LEAVES)
    return f"WITH {SQL_FACTS}, {leaves}, wide AS MATERIALIZED (SELECT * FROM cases {joins})"


def findings_sql() -> str:
    """CTEs up to ``findings``: applies, exception, satisfied, outcome by case and rule, with override truths."""
    parts = []
    for rule in RULES:
        some = " OR ".join(node_sql(x) for x in (rule.get("exceptions") or {}).values()) or "false"
        overrides = " ".join(f", {node_sql(x)} AS o_{target}" for target, x in (rule.get("overrides") or {}).items())
        parts.append(f"SELECT case_id, '{rule['rule_id']}' AS rule_id, a AS applies, CASE WHEN a THEN e END AS exception, CASE WHEN a AND NOT e THEN s END AS satisfied, coalesce(a AND NOT e, false) AS reached, CASE WHEN a IS NULL THEN 'REVIEW' WHEN NOT a THEN 'NOT_APPLICABLE' WHEN e IS NULL THEN 'REVIEW' WHEN e THEN 'NOT_APPLICABLE' WHEN s IS NULL THEN 'REVIEW' WHEN s THEN 'PASS' ELSE 'FAIL' END AS outcome FROM (SELECT case_id, {node_sql(rule['applies_when'])} AS a, ({some}) AS e, {node_sql(rule['satisfied_when'])} AS s FROM wide)")
    edges = [f"SELECT case_id, '{r['rule_id']}' AS source, '{target}' AS target, {node_sql(x)} AS truth FROM wide" for r in RULES for target, x in (r.get("overrides") or {}).items()]
    return wide_sql() + ", findings AS MATERIALIZED (" + " UNION ALL ".join(parts) + "), edges AS MATERIALIZED (" + " UNION ALL ".join(edges) + ")"
