"""Rules as data: plans of one size, areas, resolution and graphs against plain versions."""

import itertools
import math
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from gavel.operators import evaluate, packs, resolution

from .test_evaluate import EVIDENCE, FACTS


def number(case, key, n):
    return (case, f"{case}:{key}", key, "NUMBER", "RESOLVED", None, n, None, None, None, [], "r")


def many_rules(n):
    return [{"rule_id": f"R{i:05d}", "applies_when": {"op": "truth", "b": True}, "satisfied_when": {"op": "all", "args": [{"op": "greater_than", "fact_key": f"k{i % 3}", "n": i / 10}, {"op": "not", "args": [{"op": "less_than", "fact_key": "k1", "n": float(i)}]}]}} for i in range(n)]


def test_ten_thousand_rules_plan_as_ten_do(spark):
    facts = spark.createDataFrame([number(c, f"k{k}", 700.0 * c + k) for c in (1, 2) for k in (0, 1)], FACTS)
    cases = evaluate.by_case(facts, spark.createDataFrame([], EVIDENCE))
    sizes = []
    for n in (10, 10_000):
        began = time.time()
        rules = many_rules(n)
        done = resolution.resolve_findings(evaluate.evaluate_rules(cases, rules, with_evidence=False), resolution.Pack.of(rules))
        done._jdf.queryExecution().executedPlan()
        assert time.time() - began < 60
        sizes.append(len(done._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 1.2 * sizes[0]
    got = {(r["case_id"], r["rule_id"]): r["effective"] for r in resolution.exploded(done).collect()}
    assert len(got) == 20_000

    def expected(case, i):
        value, k1 = None if i % 3 == 2 else 700.0 * case + i % 3, 700.0 * case + 1
        over, under = None if value is None else value > i / 10, k1 < i
        return "FAIL" if under or over is False else "REVIEW" if over is None else "PASS"

    assert all(got[c, f"R{i:05d}"] == expected(c, i) for c in (1, 2) for i in range(10_000))


def searched(sets, gap, limit):
    """The depth-first search that the operator's count of comparisons is defined by."""
    used = 0

    def near(a, b):
        dx, dy = max(0.0, a[1] - b[1] - 0.1, b[1] - a[1] - 0.1), max(0.0, a[2] - b[2] - 0.1, b[2] - a[2] - 0.1)
        return a[0] == b[0] and math.sqrt(dx**2 + dy**2) / math.sqrt(2) <= gap

    def go(chosen):
        nonlocal used
        if len(chosen) == len(sets):
            return 1
        for r in sets[len(chosen)]:
            good = True
            for c in chosen:
                used += 1
                if used > limit:
                    return -1
                if not near(r, c):
                    good = False
                    break
            if good and (found := go([*chosen, r])):
                return found
        return 0

    return go([])


def test_areas_of_any_number_of_facts(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MOST_COMPARISONS", 12)
    rng, facts, evidence, want = random.Random(4), [], [], {}
    for case in range(120):
        k, sets = rng.choice([1, 2, 3, 4]), []
        for j in range(k):
            ids = [f"{case}-{j}-{i}" for i in range(rng.choice([1, 2, 4]))]
            regions = [(rng.randrange(1, 3), round(rng.random() * 0.5, 2), round(rng.random() * 0.5, 2)) for _ in ids]
            evidence += [(case, i, "r", "en", 1, "h", p, x, y, 0.1, 0.1) for i, (p, x, y) in zip(ids, regions)]
            facts.append((case, f"{case}:{j}", f"k{j}", "NUMBER", "RESOLVED", None, 1.0, None, None, None, ids, "r"))
            sets.append(regions)
        want[case] = {1: (True, "EVALUATED"), 0: (False, "EVALUATED"), -1: (None, "RESOURCE_LIMIT")}[searched(sets, 0.1, 12)], k
    rows = evaluate.by_case(spark.createDataFrame(facts, FACTS), spark.createDataFrame(evidence, EVIDENCE))
    for k in (1, 2, 3, 4):
        rule = {"rule_id": "R", "applies_when": {"op": "same_visual_area", "fact_keys": [f"k{j}" for j in range(k)], "gap": 0.1}, "satisfied_when": {"op": "truth", "b": True}}
        got = {r["case_id"]: (r["truth"], r["reason"]) for r in evaluate.evaluate_expressions(rows, [rule]).where("section = 'applies_when'").collect()}
        assert {c: got[c] for c, (_, n) in want.items() if n == k} == {c: x for c, (x, n) in want.items() if n == k}
        assert all(got[c][1] == "MISSING_FACT" for c, (_, n) in want.items() if n < k)
    assert {x[0][1] for x in want.values()} == {"EVALUATED", "RESOURCE_LIMIT"}


def test_resolution_against_a_plain_version(spark):
    rng, rules, rows, want = random.Random(9), [f"R{i}" for i in range(7)], [], {}
    edges = [("R0", "R1"), ("R1", "R2"), ("R0", "R2"), ("R3", "R2"), ("R4", "R5"), ("R5", "R4")]
    norms = {"R0": ("n", "PROHIBITION"), "R2": ("n", "OBLIGATION"), "R3": ("n", "PERMISSION"), "R6": ("n", "PROHIBITION")}
    pack = resolution.Pack(rules, edges, [("R6", "R1"), ("R1", "R6")], norms)
    for case in range(200):
        found = {}
        for r in rules:
            if rng.random() < 0.05:
                continue
            applies, reached = rng.choice([True, True, False, None]), rng.random() < 0.8
            outcome = "NOT_APPLICABLE" if applies is False else rng.choice(["PASS", "FAIL", "REVIEW"])
            truths = {t: rng.choice([True, False, None]) for s, t in edges if s == r} if reached else None
            found[r] = (applies, outcome, reached, truths)
            rows.append((case, r, *found[r]))
        rows.append((case, "unknown", True, "PASS", True, {}))
        effective, unsure, taken = {r: f[1] for r, f in found.items()}, {}, {}
        for s in ("R0", "R3", "R1", "R2"):  # by levels
            f = found.get(s)
            for t in (t for x, t in edges if x == s):
                if f and f[2] and f[0] and effective[s] != "NOT_APPLICABLE" and (f[3] or {}).get(t) is not False:
                    if f[3].get(t) is None:
                        unsure.setdefault(s, set()).add(t)
                        unsure.setdefault(t, set()).add(s)
                        if t in effective:
                            effective[t] = "REVIEW"
                    else:
                        taken.setdefault(t, set()).add(s)
                        if t in effective and effective[t] != "REVIEW" or t in effective and s not in unsure.get(t, ()) and not (unsure.get(t, set()) & {x for x, y in edges if y == t}):
                            effective[t] = "NOT_APPLICABLE"
        out = {}
        for r, f in found.items():
            if r in ("R4", "R5"):
                out[r] = ["INVALID", "REVIEW", {"R4", "R5"} - {r} & set(found)]
                out[r][2] = {x for x in ("R4", "R5") if x != r and x in found}
            elif unsure.get(r):
                out[r] = ["UNCERTAIN_OVERRIDE", "REVIEW", unsure[r]]
            elif taken.get(r):
                out[r] = ["OVERRIDDEN", "NOT_APPLICABLE", taken[r]]
            else:
                out[r] = ["UNCHANGED", f[1], set()]
        there = {r for r, x in out.items() if x[1] != "NOT_APPLICABLE" and x[0] != "INVALID"}
        fine = {r for r in there if out[r][0] != "UNCERTAIN_OVERRIDE"}
        links = [("R1", "R6")] if {"R1", "R6"} <= fine else []
        sides = ["R0", "R6"], ["R2", "R3"]
        for own, other in (sides, sides[::-1]):
            centre = next((r for r in other if r in there and found[r][0]), None)
            links += [(r, centre) for r in own if centre in fine and r in fine and found[r][0]]
        for a, b in {x for p in links for x in (p, p[::-1])}:
            out[a] = ["CONFLICT_REVIEW", "REVIEW", out[a][2] | {b}]
        want |= {(case, r): (x[0], x[1], sorted(x[2])) for r, x in out.items()}
    df = spark.createDataFrame(rows, "case_id long, rule_id string, applies boolean, outcome string, reached boolean, override_truths map<string, boolean>")
    done = resolution.exploded(resolution.resolve_findings(resolution.by_case(df), pack)).collect()
    assert {(r["case_id"], r["rule_id"]): (r["resolution"], r["effective"], r["related"]) for r in done} == want


def test_versions_gate_and_hash(spark):
    cases = evaluate.by_case(spark.createDataFrame([number(c, "k0", float(c)) for c in range(4)], FACTS), spark.createDataFrame([], EVIDENCE))
    rule = lambda n: [{"rule_id": "R", "applies_when": {"op": "truth", "b": True}, "satisfied_when": {"op": "greater_than", "fact_key": "k0", "n": n}}]
    versions = [packs.Version("a", "ha", rule(0.5), "2020", "2021"), packs.Version("b", "hb", rule(2.5), "2020")]
    asked = spark.createDataFrame([(0, "a", "2020"), (1, "a", "2021"), (2, "b", "2022"), (3, "c", "2020")], "case_id long, version_id string, evaluation_date string")
    got = {r["case_id"]: r for r in packs.evaluate_pack(cases.join(asked, "case_id"), versions).collect()}
    assert [got[i]["code"] for i in range(4)] == ["EVALUATED", "OUTSIDE_VALIDITY", "EVALUATED", "VERSION_UNKNOWN"]
    assert [got[i]["outcome"] for i in range(4)] == ["FAIL", None, "FAIL", None]
    assert got[1]["content_hash"] is None and len({got[0]["content_hash"], got[2]["content_hash"]}) == 2


def test_packs_beyond_the_bound_are_evaluated_in_parts(spark, monkeypatch):
    from gavel.operators import programs

    monkeypatch.setattr(programs, "ARRAY_BYTES", 1)
    monkeypatch.setattr(programs, "BROADCAST_BYTES", 0)
    cases = evaluate.by_case(spark.createDataFrame([number(c, "k0", float(c)) for c in range(6)], FACTS), spark.createDataFrame([], EVIDENCE)).withColumn("p", (F.col("case_id") % 3).cast("string"))
    rules = {str(i): [{"rule_id": "R", "applies_when": {"op": "truth", "b": True}, "satisfied_when": {"op": "greater_than", "fact_key": "k0", "n": i + 0.5}}] for i in range(3)}
    found = evaluate.evaluate_rules(cases, rules, pack="p")
    assert {r["case_id"]: r["outcome"] for r in evaluate.findings(found).collect()} == {0: "FAIL", 1: "FAIL", 2: "FAIL", 3: "PASS", 4: "PASS", 5: "PASS"}


def test_graphs_against_a_plain_version():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 8)
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.5:
            edges = [(min(e), max(e)) for e in edges if e[0] != e[1]] or [("a", "b")]
        nodes = sorted({x for e in edges for x in e})
        reach, part = {(a, b) for a, b in edges}, {v: v for v in nodes}
        for via, a, b in itertools.product(nodes, nodes, nodes):
            if (a, via) in reach and (via, b) in reach:
                reach.add((a, b))
        for _ in nodes:
            for a, b in edges:
                part[a] = part[b] = min(part[a], part[b])
        level = lambda x: max([level(a) + 1 for a, b in edges if b == x] or [0])
        for r in resolution.graph(pa.array([e[0] for e in edges]), pa.array([e[1] for e in edges])).to_pylist():
            v = r["rule_id"]
            assert r["on_cycle"] == ((v, v) in reach) and r["component"] == part[v]
            assert r["level"] == (None if any((u, u) in reach for u in nodes if part[u] == part[v]) else level(v))


def test_long_cycles_and_many_packs(spark):
    began, n = time.time(), 10_000
    ring = spark.range(n).select(F.lit(-1).cast("long").alias("p"), F.col("id").cast("string").alias("source"), ((F.col("id") + 1) % n).cast("string").alias("target"))
    chains = spark.range(1000 * 9).select((F.col("id") % 1000).alias("p"), F.floor(F.col("id") / 1000).cast("string").alias("source"), (F.floor(F.col("id") / 1000) + 1).cast("string").alias("target"))
    edges = ring.unionByName(chains)
    assert resolution.override_cycles(edges, "p").groupBy("p").count().collect() == [(-1, n)]
    assert resolution.override_levels(edges, "p").groupBy("p").agg(F.max("level").alias("m")).groupBy("m").count().collect() == [(9, 1000)]
    assert time.time() - began < 60


def test_graphs_by_rounds_are_the_same(spark, monkeypatch):
    edges = spark.createDataFrame([(1, "A", "B"), (1, "B", "A"), (1, "B", "C"), (1, "D", "E"), (1, "E", "F"), (2, "D", "D")], "p int, source string, target string")
    made = [sorted(map(tuple, f(edges, "p").collect())) for f in (resolution.override_components, resolution.override_cycles, resolution.override_levels)]
    monkeypatch.setattr(resolution, "GRAPH_EDGES", 1)
    assert made == [sorted(map(tuple, f(edges, "p").collect())) for f in (resolution.override_components, resolution.override_cycles, resolution.override_levels)]
