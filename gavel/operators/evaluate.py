"""Evaluation of declarative rules over facts with evidence.

A rule is a dict with ``rule_id``, ``applies_when``, ``satisfied_when`` and, if
it has any, ``exceptions`` (name to expression) and ``overrides`` (rule id to
expression).  An expression is a dict with ``op``; ``all``, ``any`` and ``not``
have ``args``, the others are leaves with their parameters.  Rules are data: see ``programs``.
Every case evaluates each of their different leaves once.

All facts and evidence of a case meet in one row, so one shuffle by case
serves leaves, inner nodes and findings alike.  Unknown is null.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as logic, text as texts
from .programs import ASKS, INNER, LEAF, NODES, PROGRAM, REASONS, RULES, Program, Shared, folder, folder_of_codes, leaf_row, parts, shared, table, three, united

#: Comparisons that a search for one region per fact may take.
MOST_COMPARISONS = 4096


def translate_pattern(pattern: str, full: bool = False, dot_all: bool = False, multiline: bool = False, fold: bool = False) -> str:
    """An RE2 pattern as one of Java's that matches the same.

    Unless lines count, ``$`` only matches at the very end; where they do, ``^``
    also matches behind a last line feed.  Constructs that RE2 lacks are refused.
    """
    out, i, in_class = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if re.fullmatch(r"\\[1-9]", two) or two == "\\k":
                raise ValueError("back-references are not supported")
            out += two
            i += 2
            continue
        if in_class:
            if pattern.startswith("&&", i):
                raise ValueError("class intersections are not supported")
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
                name = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}[m[2]]
                out += ("\\P" if m[1] else "\\p") + "{" + name + "}"
                i += len(m[0])
                continue
            in_class = c != "]"
            out += "\\[" if c == "[" else c
        elif c == "[":
            in_class = True
            out += c
            if pattern.startswith("^", i + 1):
                out += "^"
                i += 1
            if pattern.startswith("]", i + 1):
                out += "\\]"
                i += 1
        elif pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
            raise ValueError("only non-capturing groups are supported")
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise ValueError("possessive quantifiers are not supported")
        elif c == "$" and not multiline:
            out += r"\z"
        elif c == "^" and multiline:
            out += r"(?:\A|(?<=\n))"
        else:
            out += c
        i += 1
    flags = "d" + "s" * dot_all + "m" * multiline + "iu" * fold
    return f"(?{flags})" + (rf"\A(?:{out})\z" if full else out)


def flatten(rules: list[dict]) -> list[dict]:
    """All nodes of all sections of the rules as rows."""
    rows: list[dict] = []

    def add(rule_id: str, section: str, node: dict, path: str, parent: str | None, depth: int) -> None:
        row = {"rule_id": rule_id, "section": section, "path": path, "parent": parent, "depth": depth, "op": node["op"]}
        if node["op"] in INNER:
            for i, arg in enumerate(node["args"]):
                add(rule_id, section, arg, f"{path}.{i}", path, depth + 1)
        else:
            more = {k: v for k, v in node.items() if k not in ("op", "args", "pattern", "full", "dot_all", "multiline")}
            if "pattern" in node:
                more["pattern"] = translate_pattern(node["pattern"], node.get("full", False), node.get("dot_all", False), node.get("multiline", False), node.get("fold_pattern", False))
                more.pop("fold_pattern", None)
            row |= {"white": True, "fold": True, "form": "NFC", "with_low": True, "with_high": True, "longest": 20_000, "mode": "EXACT"} | more
        rows.append(row)

    for rule in rules:
        add(rule["rule_id"], "applies_when", rule["applies_when"], "$", None, 0)
        for name, node in (rule.get("exceptions") or {}).items():
            add(rule["rule_id"], f"exception:{name}", node, "$", None, 0)
        add(rule["rule_id"], "satisfied_when", rule["satisfied_when"], "$", None, 0)
        for target, node in (rule.get("overrides") or {}).items():
            add(rule["rule_id"], f"override:{target}", node, "$", None, 0)
    return rows


def _firsts(entries: Column) -> Column:
    """Of sorted ``struct(key, value)`` those that are the first of their key."""
    return F.filter(entries, lambda x, i: (i == 0) | (x["key"] != F.try_element_at(entries, i)["key"]))


def _forms(listed: Column) -> Column:
    """``struct(text, nfc, nfkc)`` of each of an array of texts."""

    @F.pandas_udf("array<struct<text:string,nfc:string,nfkc:string>>")
    def formed(many: pd.Series) -> pd.Series:
        return many.map(lambda xs: None if xs is None else [{"text": x, "nfc": unicodedata.normalize("NFC", x), "nfkc": unicodedata.normalize("NFKC", x)} for x in xs])

    return formed(listed)


def by_case(facts: DataFrame, evidence: DataFrame, case: str = "case_id", cases: DataFrame | None = None) -> DataFrame:
    """One row for each case with ``facts`` (by key) and ``evidence`` (by id).

    A fact has its ``row``, the Unicode ``forms`` of its text if that goes beyond ASCII, and ``complete``, which says whether all its evidence exists and comes from its
    run.  Of facts of one key the one with the least id counts, of evidence of one id
    the least; see ``check_inputs``.  ``cases`` names all cases, so that those without
    facts are judged too; else the cases are those of the facts.
    """
    value = F.struct("fact_id", "value_type", "status", "v_string", "v_number", "v_boolean", "v_date", "v_json", "evidence_ids", "provider_run_id")
    f = facts.groupBy(case).agg(F.collect_list(F.struct(F.col("fact_key").alias("key"), value.alias("value"))).alias("facts"))
    seen = F.struct("provider_run_id", "language", "document_id", "document_hash", "page", F.struct("x", "y", "width", "height").alias("box"))
    e = evidence.groupBy(case).agg(F.collect_list(F.struct(F.col("evidence_id").alias("key"), seen.alias("value"))).alias("evidence"))
    rows = f.join(e, case, "left")
    if cases is not None:
        rows = cases.select(case).distinct().join(rows, case, "left")
    return of_lists(rows, case)


def of_lists(rows: DataFrame, case: str = "case_id") -> DataFrame:
    """Rows of ``by_case`` from one row for each case with ``facts`` and ``evidence`` as arrays of ``struct(key, value)``
    in any order, null for none; a source that has them by case needs no rows of facts."""
    rows = rows.select(case, F.sort_array("facts").alias("facts"), F.sort_array("evidence").alias("evidence"))
    entries = lambda c: F.coalesce(_firsts(F.col(c)), F.array().cast(rows.schema[c].dataType))
    # Texts beyond ASCII, which are the only ones that a case sends to Python.
    beyond = F.filter(F.transform("facts", lambda x: x["value"]["v_string"]), lambda x: F.octet_length(x) > F.char_length(x))
    rows = rows.select(case, entries("facts").alias("_facts"), F.map_from_entries(entries("evidence")).alias("evidence"), _forms(F.when(F.size(beyond) > 0, F.array_distinct(beyond))).alias("_forms"))

    def one(x: Column) -> Column:
        v = x["value"]
        formed = F.when(F.col("_forms").isNotNull(), F.get(F.filter("_forms", lambda f: f["text"] == v["v_string"]), F.lit(0)))
        known = F.forall(v["evidence_ids"], lambda i: F.coalesce(F.try_element_at("evidence", i)["provider_run_id"] == v["provider_run_id"], F.lit(False)))
        return F.struct(x["key"], F.struct(v.alias("row"), formed.alias("forms"), known.alias("complete")))

    return rows.select(case, F.map_from_entries(F.transform("_facts", one)).alias("facts"), "evidence")


def _text(leaf: Column, c: Column) -> Column:
    c = F.when(leaf["white"], texts.collapse(c)).otherwise(c)
    return F.when(leaf["fold"], F.lower(c)).otherwise(c)


def _formed_text(leaf: Column, fact: Column) -> Column:
    """A fact's text as a comparison asks for: Unicode form, then white space, then case."""
    return _text(leaf, F.coalesce(F.when(leaf["form"] == "NFKC", fact["forms"]["nfkc"]).when(leaf["form"] != "", fact["forms"]["nfc"]), fact["row"]["v_string"]))


def _within(leaf: Column, value: Column, low: Column, high: Column) -> Column:
    return F.when(leaf["with_low"], value >= low).otherwise(value > low) & F.when(leaf["with_high"], value <= high).otherwise(value < high)


def _regions(fact: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(fact["row"]["evidence_ids"])), lambda i: F.try_element_at("evidence", i))


def _near(x: Column, y: Column, gap: Column) -> Column:
    """Whether two regions are of one page and within the gap of each other."""
    apart = lambda at, size: F.greatest(F.lit(0.0), x["box"][at] - y["box"][at] - y["box"][size], y["box"][at] - x["box"][at] - x["box"][size])
    close = F.sqrt(F.pow(apart("x", "width"), F.lit(2)) + F.pow(apart("y", "height"), F.lit(2))) / F.sqrt(F.lit(2.0)) <= gap
    return F.coalesce((x["document_id"] == y["document_id"]) & (x["document_hash"] == y["document_hash"]) & (x["page"] == y["page"]) & close, F.lit(False))


def _area(sets: Column, gap: Column) -> Column:
    """1: a region for each fact, all within the gap of each other; 0: none; -1: too many comparisons.

    Comparisons count as those of a depth-first search in the order of evidence ids.  Here
    all choices grow by one fact at a time, in that order; a choice's path is the places of its regions, and
    the search has made the comparisons of all paths up to that of the first full
    choice.  Each attempt takes a comparison, so no more of them are kept for a fact than the limit.
    """
    path = lambda p, r: F.struct(p.alias("path"), r.alias("regions"))
    start = F.struct(F.transform(sets[0], lambda r, i: path(F.array(i), F.array(r))).alias("choices"), F.array().cast("array<struct<path:array<int>,cost:int>>").alias("tried"))

    def widened(state: Column, regions: Column) -> Column:
        def extended(choice: Column) -> Column:
            def attempt(r: Column, j: Column) -> Column:
                failed = F.array_position(F.transform(choice["regions"], lambda c: ~_near(r, c, gap)), F.lit(True)).cast("int")
                return F.struct(F.array_append(choice["path"], j).alias("path"), F.array_append(choice["regions"], r).alias("regions"), F.when(failed == 0, F.size(choice["regions"])).otherwise(failed).alias("cost"), (failed == 0).alias("fits"))

            return F.transform(F.slice(regions, 1, MOST_COMPARISONS + 1), attempt)

        enough = F.ceil(F.lit(MOST_COMPARISONS + 1.0) / F.greatest(F.size(regions), F.lit(1))).cast("int")
        tried = F.flatten(F.transform(F.slice(state["choices"], F.lit(1), enough), extended))
        both = F.transform(F.array(tried), lambda t: F.struct(F.transform(F.filter(t, lambda x: x["fits"]), lambda x: path(x["path"], x["regions"])).alias("choices"), F.concat(state["tried"], F.transform(t, lambda x: F.struct(x["path"].alias("path"), x["cost"].alias("cost")))).alias("tried")))
        return both[0]

    def judged(state: Column) -> Column:
        first = F.get(state["choices"], F.lit(0))["path"]
        used = F.aggregate(F.filter(state["tried"], lambda x: first.isNull() | (x["path"] <= first)), F.lit(0), lambda n, x: n + x["cost"])
        return F.when(used > MOST_COMPARISONS, -1).when(first.isNull(), 0).otherwise(1)

    return F.aggregate(F.slice(sets, F.lit(2), F.greatest(F.size(sets) - 1, F.lit(0))), start, widened, judged)


def _place(name: str) -> Column:
    return F.lit(REASONS.index(name)).cast("tinyint")


def _entry(key: Column, fact: Column, others: Column | None, languages: bool, found: Column | None) -> Column:
    """What leaves under a key are judged by: the fact, or the first of several, and the reason that holds for all of them."""
    some = lambda p: F.coalesce(F.exists(others, p), F.lit(False)) if others is not None else p(fact)
    reason = F.when(some(lambda f: f.isNull()), _place("MISSING_FACT")).when(some(lambda f: ~f["complete"]), _place("MISSING_EVIDENCE")).when(some(lambda f: f["row"]["status"] != "RESOLVED"), _place("UNRESOLVED_FACT")).otherwise(_place("EVALUATED"))
    seen = F.transform(fact["row"]["evidence_ids"], lambda i: F.try_element_at("evidence", i)["language"]) if languages else F.array().cast("array<string>")
    return F.struct(key.alias("key"), fact.alias("fact"), reason.alias("reason"), seen.alias("languages"), (F.lit(None).cast("int") if found is None else found).alias("found"))


def _said(op: str, leaf: Column, e: Column) -> tuple[Column, Column]:
    """Reason, as its place in ``REASONS``, and truth of an operator's leaf over an entry, which counts where it was evaluated."""
    f = e["fact"]["row"]
    text = lambda: _formed_text(leaf, e["fact"])
    evaluated, reason = _place("EVALUATED"), e["reason"]
    if op == "present":
        known = f["status"].isin("RESOLVED", "NOT_FOUND")
        reason = F.when(reason.isin(REASONS.index("MISSING_FACT"), REASONS.index("MISSING_EVIDENCE")), reason).when(known & (F.size(f["evidence_ids"]) == 0), _place("MISSING_EVIDENCE")).when(known, evaluated).otherwise(reason)
    elif op in ASKS or op in ("eq", "not_eq"):
        reason = F.when((reason == evaluated) & (f["value_type"] != leaf["asked"]), _place("TYPE_MISMATCH")).otherwise(reason)
    if op == "matches":
        reason = F.when((reason == evaluated) & (texts.utf16_length(text()) > leaf["longest"]), _place("RESOURCE_LIMIT")).otherwise(reason)
    if op == "same_visual_area":
        reason = F.when((reason == evaluated) & (e["found"] < 0), _place("RESOURCE_LIMIT")).otherwise(reason)
    equal = lambda: F.when(leaf["asked"] == "STRING", text() == _text(leaf, leaf["s"])).when(leaf["asked"] == "NUMBER", f["v_number"] == leaf["n"]).when(leaf["asked"] == "BOOLEAN", f["v_boolean"] == leaf["b"]).when(leaf["asked"] == "DATE", f["v_date"] == leaf["s"])
    truth = {
        "present": lambda: f["status"] == "RESOLVED", "eq": equal, "not_eq": lambda: ~equal(),
        "contains": lambda: text().contains(_text(leaf, leaf["s"])), "contains_any": lambda: F.exists(leaf["many"], lambda m: text().contains(_text(leaf, m))), "matches": lambda: F.regexp_like(text(), leaf["pattern"]),
        "greater_than": lambda: f["v_number"] > leaf["n"], "less_than": lambda: f["v_number"] < leaf["n"], "date_before": lambda: f["v_date"] < leaf["s"], "date_after": lambda: f["v_date"] > leaf["s"],
        "between": lambda: _within(leaf, f["v_number"], leaf["low"], leaf["high"]), "date_between": lambda: _within(leaf, f["v_date"], leaf["date_low"], leaf["date_high"]),
        "language_present": lambda: F.exists(e["languages"], lambda x: F.when(leaf["mode"] == "EXACT", texts.language_matches(x, leaf["s"], "EXACT")).otherwise(texts.language_matches(x, leaf["s"], "PRIMARY"))),
        "same_visual_area": lambda: e["found"] == 1,
    }
    if op not in truth:
        raise ValueError(f"unknown operator {op}")
    return reason, truth[op]()


def _state(reason: Column, truth: Column) -> Column:
    """0, 1 (unknown) or 2."""
    return F.when(reason == _place("EVALUATED"), F.coalesce(truth.cast("tinyint") * 2, F.lit(1))).otherwise(1).cast("tinyint")


def _judged(op: str, leaf: Column, e: Column) -> Column:
    """``struct(leaf, truth, reason)`` of an operator's leaf over an entry."""
    reason, truth = _said(op, leaf, e)
    return F.transform(F.array(reason), lambda r: F.struct(leaf["leaf"].alias("leaf"), _state(r, truth).alias("truth"), r.alias("reason")))[0]


def _constant(row: dict) -> Column:
    """The parameters of one leaf as a struct of constants."""
    kinds = {pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.int32(): "int"}
    one = lambda f: F.array(*map(F.lit, row[f.name] or [])).cast("array<string>") if f.name == "many" else F.lit(row[f.name]).cast(kinds[f.type])
    return F.struct(*[one(f).alias(f.name) for f in LEAF])


#: Different leaves of all packs up to which each is an expression of its own, which Spark compiles; more are rows of parameters.
OWN_LEAVES = 64


def _by_columns(cases: DataFrame, own: Shared, case: str, keep: list[str]) -> DataFrame:
    """``(case, pack, facts, nodes)`` and ``keep``: leaves are judged over a column for each fact that they are about."""
    rows = {i: leaf_row(leaf, i) for i, leaf in enumerate(own.leaves) if leaf["op"] != "truth"}
    keys = {key: f"_fact{n}" for n, key in enumerate(dict.fromkeys(own.leaves[i]["fact_key"] for i in rows))}
    cases = cases.select(case, "pack", "facts", "evidence", *keep, *[F.try_element_at("facts", F.lit(key)).alias(name) for key, name in keys.items()])

    def code(i: int) -> Column:
        op, key = own.leaves[i]["op"], own.leaves[i]["fact_key"]
        reason, truth = _said(op, _constant(rows[i]), _entry(F.lit(key), F.col(keys[key]), None, op == "language_present", None))
        return (reason * 4 + _state(reason, truth)).cast("tinyint")

    cases = cases.select(case, "pack", "facts", *keep, F.array(*map(code, rows)).cast("array<tinyint>").alias("_codes"))
    return cases.select(case, "pack", "facts", *keep, folder_of_codes(own.arrays, list(rows))("pack", "_codes").alias("nodes"))


#: One pack's rules, or a dict from pack to rules with the cases' column that names the pack.
Rules = list[dict] | dict[str, list[dict]]


def compiled(rules: Rules) -> dict[str, Program]:
    return {name: Program(flatten(r)) for name, r in (rules.items() if isinstance(rules, dict) else [("", rules)])}


def _folded(cases: DataFrame, programs: dict[str, Program], case: str, pack: str | None, keep: list[str] = ()) -> DataFrame:
    """``(case, pack, facts, nodes)`` and ``keep``: truths and reasons of all nodes of a case's pack, in its row.  Cases of
    other packs are left out."""
    ops = {leaf["op"] for p in programs.values() for leaf in p.leaves}
    rows = cases.select(case, (F.col(pack).cast("string") if pack else F.lit("")).alias("pack"), "facts", "evidence", *keep)
    own = shared(programs)
    if len(own.leaves) <= OWN_LEAVES and "same_visual_area" not in ops:
        return _by_columns(rows.where(F.col("pack").isin(*programs)) if pack else rows, own, case, keep)
    tables = table(cases.sparkSession, [p.program_row(name) for name, p in programs.items()], PROGRAM)
    rows = rows.join(tables, "pack")
    languages = "language_present" in ops
    entries = F.transform(F.map_entries("facts"), lambda e: _entry(e["key"], e["value"], None, languages, None))
    if "same_visual_area" in ops:
        fact = lambda k: F.try_element_at("facts", k)
        entries = F.concat(entries, F.transform("areas", lambda a: _entry(a["key"], fact(a["keys"][0]), F.transform(a["keys"], fact), languages, _area(F.transform(a["keys"], lambda k: _regions(fact(k))), a["gap"]))))
    # An expression for each operator, over that operator's leaves of each fact.
    kind = tables.schema["leaves"].dataType.valueType
    own = lambda op, e: F.coalesce(F.try_element_at("leaves", F.concat(F.lit(f"{op}\0"), e["key"])), F.array().cast(kind))

    def judged(op: str) -> Column:
        return F.flatten(F.transform("_entries", lambda e: F.transform(own(op, e), lambda leaf: _judged(op, leaf, e))))

    none = F.array().cast("array<struct<leaf:int,truth:tinyint,reason:tinyint>>")
    rows = rows.withColumn("_entries", entries).select(case, "pack", "facts", *keep, F.concat(none, *[judged(op) for op in sorted(ops - {"truth"})]).alias("_results"))
    run = folder({name: p.arrays() for name, p in programs.items()})
    return rows.select(case, "pack", "facts", *keep, run(F.col("pack"), F.col("_results.leaf"), F.col("_results.truth"), F.col("_results.reason")).alias("nodes"))


def _evidence(groups: Column) -> Column:
    """The evidence of facts; of a group of facts only if all are there and complete."""
    fact = lambda k: F.try_element_at("facts", k)
    whole = F.filter(groups, lambda g: F.forall(g, lambda k: F.coalesce(fact(k)["complete"], F.lit(False))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(whole), lambda k: fact(k)["row"]["evidence_ids"]))))


def evaluate_expressions(cases: DataFrame, rules: Rules, case: str = "case_id", pack: str | None = None, dealt: bool = False) -> DataFrame:
    """A row for each case and node: truth (null: unknown), reason, and the evidence it rests on.

    ``cases`` comes from ``by_case``; with rules of several packs, its column ``pack`` names each case's.
    All nodes are worked out in a case's row, without a shuffle, and then exploded.  ``dealt`` deals the cases before that, so that
    what groups their nodes by case need not shuffle these, which are many times larger.
    """
    out = []
    for programs in parts(compiled(rules)):
        rows = _folded(cases, programs, case, pack)
        if dealt:
            # Of the facts, nodes only need the evidence.
            rows = rows.withColumn("facts", F.transform_values("facts", lambda k, v: F.struct(v["complete"].alias("complete"), F.struct(v["row"]["evidence_ids"].alias("evidence_ids")).alias("row")))).repartition(case)
        rows = rows.select(case, "pack", "facts", F.posexplode(F.arrays_zip("nodes.truth", "nodes.reason")).alias("node", "_n"))
        nodes = table(cases.sparkSession, [r for name, p in programs.items() for r in p.node_rows(name)], NODES)
        names = F.array(*[F.lit(r) for r in REASONS])
        out.append(rows.join(nodes, ["pack", "node"]).select(case, *([F.col("pack").alias(pack)] if pack else []), "rule_id", "section", "path", "parent", "depth", "op", three(F.col("_n.truth")).alias("truth"), F.get(names, F.col("_n.reason").cast("int")).alias("reason"), _evidence(F.col("groups")).alias("evidence_ids")))
    return united(out)


def evaluate_rules(cases: DataFrame, rules: Rules, case: str = "case_id", pack: str | None = None, with_evidence: bool = True, keep: list[str] = ()) -> DataFrame:
    """``(case, found)``, the pack and ``keep``: an array with each rule's id, applies, exception, satisfied, whether the last section
    was reached, outcome, override truths and evidence, in the row of the case.

    Exceptions count only where the rule applies; the last section and overrides
    only where, besides, no exception holds or may hold.  ``with_evidence=False`` leaves the evidence
    empty, for outcomes and resolution alone.
    """
    none = F.array().cast("array<string>")
    truth = lambda i: three(F.get("nodes.truth", i))

    def finding(rule_id: Column, applies: Column, some: Column, holds: Column, own: Column, groups: tuple[Column, Column, Column]) -> Column:
        reached = F.coalesce(applies & ~some, F.lit(False))
        seen = _evidence(F.when(reached, groups[2]).when(applies, groups[1]).otherwise(groups[0])) if with_evidence else none
        return F.struct(rule_id.alias("rule_id"), applies.alias("applies"), F.when(applies, some).alias("exception"), F.when(reached, holds).alias("satisfied"), reached.alias("reached"), logic.derive_outcome(applies, some, holds).alias("outcome"), F.when(reached, own).alias("override_truths"), seen.alias("evidence_ids"))

    def found(r: Column) -> Column:
        said = F.struct(truth(r["applies"]).alias("a"), F.exists(r["exceptions"], truth).alias("e"), truth(r["satisfied"]).alias("s"))
        own = F.map_from_entries(F.transform(r["overrides"], lambda o: F.struct(o["target"], truth(o["node"]))))
        return F.transform(F.array(said), lambda x: finding(r["rule_id"], x["a"], x["e"], x["s"], own, (r["first"], r["second"], r["third"])))[0]

    def constant(r: dict) -> Column:
        root = lambda i: F.col(f"_node{i}")
        some = reduce(lambda a, b: a | b, map(root, r["exceptions"]), F.lit(False))
        own = F.create_map(*[c for o in r["overrides"] for c in (F.lit(o["target"]), root(o["node"]))]) if r["overrides"] else F.create_map().cast("map<string,boolean>")
        groups = [F.array(*[F.array(*map(F.lit, g)) for g in r[n]]).cast("array<array<string>>") for n in ("first", "second", "third")]
        return finding(F.lit(r["rule_id"]), root(r["applies"]), some, root(r["satisfied"]), own, groups)

    out = []
    for programs in parts(compiled(rules)):
        rows, listed = _folded(cases, programs, case, pack, keep), [p.rules_row(name) for name, p in programs.items()]
        # Versions of a pack often have the same rules, which are then written once.
        same: dict[str, list[dict]] = {}
        for row in listed:
            same.setdefault(json.dumps(row["rules"]), []).append(row)
        if sum(len(x[0]["rules"]) for x in same.values()) <= OWN_LEAVES and all(x[0]["rules"] for x in same.values()):
            made = [(F.col("pack").isin(*[row["pack"] for row in x]), F.array(*[constant(r) for r in x[0]["rules"]])) for x in same.values()]
            column = reduce(lambda c, m: c.when(*m), made[1:], F.when(*made[0]))
            roots = sorted({i for x in same.values() for r in x[0]["rules"] for i in (r["applies"], r["satisfied"], *r["exceptions"], *(o["node"] for o in r["overrides"]))})
            rows = rows.select(case, "pack", "facts", *keep, *[truth(F.lit(i)).alias(f"_node{i}") for i in roots])
        else:
            rows, column = rows.join(table(cases.sparkSession, listed, RULES), "pack"), F.transform("rules", found)
        out.append(rows.select(case, *([F.col("pack").alias(pack)] if pack else []), *keep, column.alias("found")))
    return united(out)


def findings(found: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each case and rule of ``evaluate_rules``."""
    return found.select(case, F.explode("found").alias("x")).select(case, "x.*")


def outcomes(found: Column, field: str = "outcome") -> Column:
    """The gravest outcome of an array of findings: FAIL, REVIEW, PASS, NOT_APPLICABLE."""
    order = F.array(*[F.lit(o) for o in ("NOT_APPLICABLE", "PASS", "REVIEW", "FAIL")])
    return F.element_at(order, F.array_max(F.transform(found, lambda x: F.array_position(order, x[field]))).cast("int"))


def aggregate_outcomes(rows: DataFrame, outcome: str, *by: str) -> DataFrame:
    """The gravest outcome of each group: FAIL, REVIEW, PASS, NOT_APPLICABLE."""
    return rows.groupBy(*by).agg(F.max_by(outcome, logic.rank(F.col(outcome), logic.OUTCOMES)).alias("outcome"))


def check_inputs(facts: DataFrame, evidence: DataFrame, rules: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """``(case_id, code, key, n)`` for fact ids, fact keys, evidence ids and rule ids that are not unique."""
    def twice(df: DataFrame, code: str, key: str, by: list[str]) -> DataFrame:
        return df.groupBy(*by, key).count().where("count > 1").select(*(by or [F.lit(None).cast("long").alias(case)]), F.lit(code).alias("code"), F.col(key).cast("string").alias("key"), F.col("count").alias("n"))

    out = twice(facts, "DUPLICATE_FACT_ID", "fact_id", [case]).unionByName(twice(facts, "DUPLICATE_FACT_KEY", "fact_key", [case])).unionByName(twice(evidence, "DUPLICATE_EVIDENCE_ID", "evidence_id", [case]))
    return out if rules is None else out.unionByName(twice(rules, "DUPLICATE_RULE_ID", "rule_id", []))


def check_facts(facts: DataFrame, case: str = "case_id") -> DataFrame:
    """``(case, fact_id, code)`` of facts whose value, type, evidence or confidence does not suit their status."""
    n = F.size("evidence_ids")
    value = F.when(F.col("value_type") == "STRING", F.col("v_string").isNotNull()).when(F.col("value_type") == "NUMBER", F.col("v_number").isNotNull()).when(F.col("value_type") == "BOOLEAN", F.col("v_boolean").isNotNull()).when(F.col("value_type") == "DATE", F.col("v_date").isNotNull()).otherwise(F.col("v_json").isNotNull())
    any_value = F.coalesce("v_string", F.col("v_number").cast("string"), F.col("v_boolean").cast("string"), "v_date", "v_json").isNotNull()
    code = (
        F.when((F.col("status") == "RESOLVED") & ~value, "VALUE_MISSING").when((F.col("status") != "RESOLVED") & any_value, "VALUE_UNEXPECTED")
        .when((F.col("status") == "CONFLICT") & (n < 2), "EVIDENCE_TOO_FEW").when(F.col("status").isin("RESOLVED", "NULL", "NOT_READABLE") & (n < 1), "EVIDENCE_MISSING")
        .when((F.col("status") == "CONFLICT") & F.col("raw_confidence").isNotNull(), "CONFIDENCE_UNEXPECTED").when((F.col("raw_confidence") < 0) | (F.col("raw_confidence") > 1), "CONFIDENCE_RANGE")
    )
    return facts.select(case, "fact_id", code.alias("code")).where("code is not null")
