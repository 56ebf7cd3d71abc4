"""Effects of rules on each other: overrides, declared and deontic conflicts.

The override graph belongs to the pack, not to a case.  ``Pack`` works out its
components, cycles and levels once, from the rules' metadata, which is bounded
by the size of a pack, as arrays of edges and links.  A case then is one row with an array of its findings,
and many cases are resolved at a time, level by level of the graph, as matrices of rules and
cases; a case is not shuffled again, and a plan has one size whatever the number of rules.

``override_components``, ``override_cycles`` and ``override_levels`` do the same
for tables of graphs, a graph for each pack.  Where no pack has more than ``GRAPH_EDGES`` edges, which
is counted first, a pack is worked out in one pass by one task, and packs are dealt by their keys;
larger graphs are peeled and labelled by joins, round by round.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as logic


def _state(df: DataFrame) -> tuple:
    """Tells whether a table has changed, without its rows."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def _cut(df: DataFrame) -> DataFrame:
    """The table without its lineage: in the shared folder where there is one, else in memory."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getCheckpointDir():
        if not df.sparkSession.sparkContext.getCheckpointDir():
            df.sparkSession.sparkContext.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
        return df.checkpoint()
    return df.persist()


def _components_by_rounds(edges: DataFrame, *pack: str) -> DataFrame:
    """``(*pack, rule_id, component)``: least rule id of the undirected component; ``edges`` has source and target."""
    p = list(pack)
    both = edges.select(*p, F.col("source").alias("a"), F.col("target").alias("b"))
    both = _cut(both.unionByName(both.select(*p, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(*p, F.col("a").alias("rule_id"), F.col("a").alias("component")).distinct()
    before = None
    while True:
        near = both.join(labels.withColumnRenamed("rule_id", "b"), [*p, "b"]).groupBy(*p, F.col("a").alias("rule_id")).agg(F.min("component").alias("m"))
        labels = _cut(labels.join(near, [*p, "rule_id"]).select(*p, "rule_id", F.least("component", "m").alias("component")))
        state = _state(labels)
        if state == before:
            return labels
        before = state


def _leftovers(edges: DataFrame, inner: str, outer: str, p: list[str]) -> DataFrame:
    """Edges that stay when those are taken away whose ``inner`` end is no other edge's ``outer`` end."""
    left, before = _cut(edges.select(*p, "source", "target").distinct()), None
    while (state := _state(left)) != before:
        before = state
        left = _cut(left.join(left.select(*p, F.col(outer).alias(inner)).distinct(), [*p, inner], "left_semi").select(*p, "source", "target"))
    return left


def _cycles_by_rounds(edges: DataFrame, *pack: str) -> DataFrame:
    """``(*pack, rule_id)`` of nodes on directed cycles.

    Edges that nothing leads to, or that lead nowhere, are peeled off in turn.
    What is left are cycles and the ways between them; a node is on a cycle if
    it reaches itself, which is looked up within what is left.
    """
    p = list(pack)
    core = _leftovers(_leftovers(edges, "source", "target", p), "target", "source", p)
    paths, before = core, None
    while (state := _state(paths)) != before:
        before = state
        longer = paths.withColumnRenamed("target", "via").join(core.withColumnRenamed("source", "via"), [*p, "via"]).select(*p, "source", "target")
        paths = _cut(paths.unionByName(longer).distinct())
    return paths.where("source = target").select(*p, F.col("source").alias("rule_id")).distinct()


def _levels_by_rounds(edges: DataFrame, *pack: str) -> DataFrame:
    """``(*pack, rule_id, level)``: longest path from a rule that nothing overrides; rules of components with cycles are left out."""
    p = list(pack)
    parts = _components_by_rounds(edges, *p)
    bad = _cycles_by_rounds(edges, *p).join(parts, [*p, "rule_id"]).select(*p, "component").distinct()
    levels = _cut(parts.join(bad, [*p, "component"], "left_anti").select(*p, "rule_id", F.lit(0).alias("level")))
    fine = _cut(edges.join(levels.select(*p, F.col("rule_id").alias("source")), [*p, "source"], "left_semi").select(*p, "source", "target").distinct())
    before = None
    while (state := _state(levels)) != before:
        before = state
        up = fine.join(levels.withColumnRenamed("rule_id", "source"), [*p, "source"]).groupBy(*p, F.col("target").alias("rule_id")).agg((F.max("level") + 1).alias("up"))
        levels = _cut(levels.join(up, [*p, "rule_id"], "left").select(*p, "rule_id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
    return levels


#: Edges of a pack up to which one task works out its graph.
GRAPH_EDGES = 2_000_000


def _strong(n: int, starts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Strongly connected component of each node, by one depth-first search without recursion;
    ``targets[starts[i]:starts[i + 1]]`` are the targets of node i."""
    starts, targets = starts.tolist(), targets.tolist()
    index, low, out, on, stack, count, part = [-1] * n, [0] * n, [-1] * n, [False] * n, [], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, starts[root])]
        while work:
            v, at = work.pop()
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            elif at > starts[v]:
                low[v] = min(low[v], low[targets[at - 1]]) if on[targets[at - 1]] else low[v]
            while at < starts[v + 1] and index[w := targets[at]] >= 0:
                if on[w]:
                    low[v] = min(low[v], index[w])
                at += 1
            if at < starts[v + 1]:
                work += [(v, at + 1), (targets[at], starts[targets[at]])]
            elif low[v] == index[v]:
                while True:
                    w = stack.pop()
                    on[w], out[w] = False, part
                    if w == v:
                        break
                part += 1
    return np.array(out, np.int64)


def graph(source: pa.Array, target: pa.Array, group: np.ndarray | None = None) -> pa.Table:
    """``rule_id, component, on_cycle, level`` of the nodes of one graph; no level where the component has a cycle.

    With ``group``, a number for each edge, the graphs of all groups side by side, with a column ``group``.
    """
    names = sorted(set(pc.unique(source).to_pylist()) | set(pc.unique(target).to_pylist()))
    words = pa.array(names, pa.string())
    s, t = (np.asarray(pc.index_in(x, words)).astype(np.int64) for x in (source, target))
    if group is not None:
        s, t = s + group * len(names), t + group * len(names)
    nodes, codes = np.unique(np.concatenate([s, t]), return_inverse=True)
    n, s, t = len(nodes), codes[: len(s)], codes[len(s) :]
    words = words.take(pa.array(nodes % max(1, len(names))))
    pairs = np.unique(np.column_stack([s, t]), axis=0)
    s, t = pairs[:, 0], pairs[:, 1]
    starts = np.searchsorted(s, np.arange(n + 1))
    strong = _strong(n, starts, t)
    size = np.bincount(strong, minlength=n)
    cycle = size[strong] > 1
    cycle[s[s == t]] = True
    # Components by least node: labels halve their chains in each round.
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, s, label[t])
        np.minimum.at(least, t, label[s])
        np.minimum.at(least, label, least.copy())
        least = least[least]
        if (least == label).all():
            break
        label = least
    bad = np.zeros(n, bool)
    bad[label[cycle]] = True
    # Strong components are numbered targets first, so sources come in falling order of their numbers.
    level = [0] * n
    for v in np.argsort(-strong, kind="stable").tolist():
        for w in t[starts[v] : starts[v + 1]].tolist():
            level[w] = max(level[w], level[v] + 1)
    owner = {} if group is None else {"group": pa.array(nodes // max(1, len(names)))}
    return pa.table({**owner, "rule_id": words, "component": words.take(pa.array(label)), "on_cycle": pa.array(cycle), "level": pa.array(np.array(level, np.int32), mask=bad[label])})


#: Edges of many packs whose graphs a task works out at a time.
GRAPHS_ROWS = 200_000


def _begins(found: pa.Table, pack: tuple[str, ...]) -> np.ndarray:
    """Whether each of sorted rows is the first of its pack."""
    new = np.zeros(len(found), bool)
    new[:1] = True
    for c in pack:
        column = found.column(c).combine_chunks()
        null = np.asarray(column.is_null())
        differs = np.asarray(pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False))
        new[1:] |= differs | (null[1:] != null[:-1])
    return new


def override_graphs(edges: DataFrame, *pack: str) -> DataFrame | None:
    """``(*pack, rule_id, component, on_cycle, level)``; None where a pack has more than ``GRAPH_EDGES`` edges.

    Edges with a missing end are none; repeated edges are one.  A pack may be null.  A task goes through its packs in their
    order and works out as many as have ``GRAPHS_ROWS`` edges in one pass, as most packs are small.
    """
    rows = edges.where("source is not null and target is not null").select(*pack, F.col("source").cast("string"), F.col("target").cast("string"))
    most = rows.groupBy(*pack).count().agg(F.max("count")).first()[0] or 0
    if most > GRAPH_EDGES:
        return None
    key = [rows.schema[c] for c in pack]
    out = T.StructType([*key, T.StructField("rule_id", T.StringType()), T.StructField("component", T.StringType()), T.StructField("on_cycle", T.BooleanType()), T.StructField("level", T.IntegerType())])

    enough = GRAPHS_ROWS

    def made(found: pa.Table, new: np.ndarray) -> pa.Table:
        begins = np.flatnonzero(new)
        of = graph(found.column("source").combine_chunks(), found.column("target").combine_chunks(), np.cumsum(new) - 1)
        first = pa.array(begins[of.column("group").to_numpy()])
        return pa.table([*[found.column(c).combine_chunks().take(first) for c in pack], *of.columns[1:]], names=[f.name for f in out])

    def many(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= enough:
                found = pa.Table.from_batches(held)
                new = _begins(found, pack)
                last = int(np.flatnonzero(new)[-1])
                if last:
                    yield from made(found.slice(0, last), new[:last]).to_batches()
                held = found.slice(last).combine_chunks().to_batches()
                size = len(found) - last if last else 0
        if held:
            found = pa.Table.from_batches(held)
            if len(found):
                yield from made(found, _begins(found, pack)).to_batches()

    return (rows.repartition(*pack).sortWithinPartitions(*pack) if pack else rows.repartition(1)).mapInArrow(many, out)


def override_components(edges: DataFrame, *pack: str) -> DataFrame:
    """``(*pack, rule_id, component)``: least rule id of the undirected component; ``edges`` has source and target."""
    made = override_graphs(edges, *pack)
    return _components_by_rounds(edges, *pack) if made is None else made.select(*pack, "rule_id", "component")


def override_cycles(edges: DataFrame, *pack: str) -> DataFrame:
    """``(*pack, rule_id)`` of nodes on directed cycles."""
    made = override_graphs(edges, *pack)
    return _cycles_by_rounds(edges, *pack) if made is None else made.where("on_cycle").select(*pack, "rule_id")


def override_levels(edges: DataFrame, *pack: str) -> DataFrame:
    """``(*pack, rule_id, level)``: longest path from a rule that nothing overrides; rules of components with cycles are left out."""
    made = override_graphs(edges, *pack)
    return _levels_by_rounds(edges, *pack) if made is None else made.where("level is not null").select(*pack, "rule_id", "level")


@dataclass
class Pack:
    """A pack's relations between rules: ``edges`` (source, target), ``declared`` pairs, and ``norms``
    (rule id to norm and category)."""

    rules: list[str]
    edges: list[tuple[str, str]] = field(default_factory=list)
    declared: list[tuple[str, str]] = field(default_factory=list)
    norms: dict[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, rules: list[dict], declared: list[tuple[str, str]] = (), norms: dict[str, tuple[str, str]] | None = None) -> Pack:
        return cls([r["rule_id"] for r in rules], [(r["rule_id"], t) for r in rules for t in (r.get("overrides") or {})], list(declared), dict(norms or {}))

    @functools.cached_property
    def near(self) -> dict[str, set[str]]:
        """Rules that share an edge, by rule."""
        out: dict[str, set[str]] = {}
        for s, t in self.edges:
            out.setdefault(s, set()).add(t)
            out.setdefault(t, set()).add(s)
        return out

    @functools.cached_property
    def levels(self) -> dict[str, int]:
        """Longest path from a rule that nothing overrides, by rule; those on or behind cycles are left out.
        Each edge is looked at once, when its source is done."""
        targets: dict[str, list[str]] = {}
        waits: dict[str, int] = dict.fromkeys(self.near, 0)
        for s, t in set(self.edges):
            targets.setdefault(s, []).append(t)
            waits[t] += 1
        out, ready = {}, [r for r, n in waits.items() if not n]
        level = dict.fromkeys(waits, 0)
        while ready:
            r = ready.pop()
            out[r] = level[r]
            for t in targets.get(r, ()):
                level[t] = max(level[t], level[r] + 1)
                waits[t] -= 1
                if not waits[t]:
                    ready.append(t)
        return {r: n for r, n in out.items() if r not in self._spread(set(waits) - set(out))}

    def _spread(self, bad: set[str]) -> set[str]:
        """The components that have one of ``bad``."""
        seen, queue = set(bad), list(bad)
        while queue:
            for x in self.near[queue.pop()]:
                if x not in seen:
                    seen.add(x)
                    queue.append(x)
        return seen

    @functools.cached_property
    def invalid(self) -> set[str]:
        """Rules of components that hold a cycle."""
        return set(self.near) - set(self.levels)

    @functools.cached_property
    def arrays(self) -> Relations:
        return Relations.of(self)


@dataclass
class Relations:
    """A pack's relations as numbers: rules in the order of their ids, edges of valid components by the
    level of their source, links of conflicts."""

    names: pa.Array
    source: np.ndarray
    target: np.ndarray
    level: np.ndarray
    invalid: np.ndarray
    around: tuple[np.ndarray, np.ndarray]
    declared: tuple[np.ndarray, np.ndarray]
    norms: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, pack: Pack) -> Relations:
        names = sorted(set(pack.rules))
        at = {r: i for i, r in enumerate(names)}
        pairs = lambda xs: tuple(np.array([at[x[i]] for x in xs], np.int64) for i in range(2))
        edges = sorted({e for e in pack.edges if e[0] in pack.levels and e[0] in at and e[1] in at}, key=lambda e: (pack.levels[e[0]], e[1], e[0]))
        bad = sorted(pack.invalid & set(at))
        sides: dict[str, tuple[list[int], list[int]]] = {}
        for rule, (norm, category) in pack.norms.items():
            if category in ("PROHIBITION", "OBLIGATION", "PERMISSION") and rule in at:
                sides.setdefault(norm, ([], []))[category != "PROHIBITION"].append(at[rule])
        norms = [(np.sort(p), np.sort(o)) for p, o in sides.values() if p and o]
        return cls(pa.array(names, pa.string()), *pairs(edges), np.array([pack.levels[s] for s, _ in edges], np.int64), np.isin(names, bad), pairs([(r, n) for r in bad for n in sorted(pack.near[r] - {r}) if n in at]), pairs(sorted({(min(p), max(p)) for p in pack.declared if p[0] != p[1] and set(p) <= set(at)})), norms)


def check_finding_map(findings: DataFrame, rules: DataFrame, case: str = "case_id", finding_hash: str | None = None) -> DataFrame:
    """``(case, valid)``: whether a case has exactly one finding for each rule of the pack.

    With ``finding_hash``, a column of the findings, each must equal ``rule_hash`` of its rule.
    """
    hashed = [F.col("rule_hash").alias("known_hash")] if finding_hash else []
    known = rules.select(F.col("rule_id").alias("known"), *hashed).distinct()
    total = rules.select("rule_id").distinct().count()
    matches = F.col("known").isNotNull() & (F.col(finding_hash).eqNullSafe(F.col("known_hash")) if finding_hash else F.lit(True))
    seen = findings.join(known, findings.rule_id == known.known, "left").groupBy(case).agg(F.count("*").alias("rows"), F.countDistinct("rule_id").alias("ids"), F.count_if(matches).alias("matched"))
    return seen.select(case, ((F.col("rows") == total) & (F.col("ids") == total) & (F.col("matched") == total)).alias("valid"))


def validate_override_edges(edges: DataFrame, findings: DataFrame, rules: DataFrame, case: str = "case_id", declared: DataFrame | None = None) -> DataFrame:
    """Violations of override edges in a case: a missing end, no common validity, a trace where
    there must be none, or none where there must be one, an edge traced twice; with ``declared``
    conflicts (a, b), those of a rule that the pack lacks.

    ``edges``: case, source, target, traced; ``rules``: rule_id, valid_from, valid_to.
    """
    from ..functions.dates import overlap

    s = rules.select(F.col("rule_id").alias("source"), F.col("valid_from").alias("sf"), F.col("valid_to").alias("st"))
    t = rules.select(F.col("rule_id").alias("target"), F.col("valid_from").alias("tf"), F.col("valid_to").alias("tt"), F.lit(True).alias("has_target"))
    f = findings.select(case, F.col("rule_id").alias("source"), "reached")
    once = edges.groupBy(case, "source", "target").agg(F.max("traced").alias("traced"), F.count_if("traced").alias("times"))
    rows = once.join(s, "source", "left").join(t, "target", "left").join(f, [case, "source"], "left")
    code = (
        F.when(F.col("has_target").isNull() | F.col("reached").isNull(), "MISSING_ENDPOINT")
        .when(~overlap(F.col("sf"), F.col("st"), F.col("tf"), F.col("tt")), "VALIDITY_MISMATCH").when(F.col("times") > 1, "DUPLICATE_TRACE")
        .when(F.col("reached") & ~F.col("traced"), "TRACE_REQUIRED").when(~F.col("reached") & F.col("traced"), "TRACE_UNEXPECTED")
    )
    out = rows.select(case, "source", "target", code.alias("code")).where("code is not null")
    if declared is None:
        return out
    ids = rules.select(F.col("rule_id").alias("id")).distinct()
    dangling = declared.join(ids, declared.a == ids.id, "left").withColumnRenamed("id", "a_id").join(ids, declared.b == ids.id, "left").where("a_id is null or id is null")
    return out.unionByName(dangling.select(F.lit(None).cast(out.schema[case].dataType).alias(case), F.col("a").alias("source"), F.col("b").alias("target"), F.lit("DANGLING_CONFLICT").alias("code")))


def by_case(findings: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each case with ``found``, an array of its findings."""
    return findings.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("rule_id", "applies", "outcome", "reached", F.map_entries("override_truths").alias("o")))).alias("found")).select(case, F.transform("found", lambda x: F.struct(x["rule_id"].alias("rule_id"), x["applies"].alias("applies"), x["outcome"].alias("outcome"), x["reached"].alias("reached"), F.map_from_entries(x["o"]).alias("override_truths"))).alias("found"))


RESOLUTIONS = ["UNCHANGED", "OVERRIDDEN", "UNCERTAIN_OVERRIDE", "INVALID", "CONFLICT_REVIEW"]
UNCHANGED, OVERRIDDEN, UNCERTAIN, INVALID, CONFLICT = range(5)
NOT_APPLICABLE, REVIEW = logic.OUTCOMES.index("NOT_APPLICABLE"), logic.OUTCOMES.index("REVIEW")
RESOLVED = T.StructType([T.StructField("resolution", T.ArrayType(T.StringType())), T.StructField("effective", T.ArrayType(T.StringType())), T.StructField("related", T.ArrayType(T.ArrayType(T.StringType())))])
#: Rules times cases that are resolved at a time.
CELLS = 1 << 22


def _lists(flat: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)


class _Cases:
    """Findings of some cases against a pack: matrices of rules (rows) and cases (columns)."""

    def __init__(self, pack: Relations, rule: pa.Array) -> None:
        self.pack, self.n = pack, len(rule)
        self.sizes = rule.value_lengths().fill_null(0).to_numpy()
        at = pc.index_in(rule.flatten(), pack.names)
        self.known = np.flatnonzero(~np.asarray(at.is_null()))
        self.rule = at.take(pa.array(self.known)).to_numpy().astype(np.int64)
        self.case = np.repeat(np.arange(self.n), self.sizes)[self.known]
        self.place = np.full((len(pack.names), self.n), -1, np.int64)
        self.place[self.rule, self.case] = np.arange(len(self.known))

    def matrix(self, values: np.ndarray, missing: int = 0) -> np.ndarray:
        out = np.full(self.place.shape, missing, np.int8)
        out[self.rule, self.case] = values[self.known]
        return out

    def lists(self, resolution: np.ndarray, effective: np.ndarray, triples: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
        """The answer for each finding, null for rules that the pack lacks; ``triples``: rule, case and related
        rule, in any order and repeated."""
        rule, case, other = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *triples))
        r, total = max(1, len(self.pack.names)), int(self.sizes.sum())
        key = np.unique(self.known[self.place[rule, case]] * r + other)
        names = _lists(self.pack.names.take(pa.array(key % r)), np.bincount(key // r, minlength=total))
        unknown = np.ones(total, bool)
        unknown[self.known] = False

        def said(m: np.ndarray, words: list[str]) -> pa.Array:
            at = np.zeros(total, np.int64)
            at[self.known] = m[self.rule, self.case]
            return pa.array(words, pa.string()).take(pa.array(at, mask=unknown))

        return pa.StructArray.from_arrays([_lists(x, self.sizes) for x in (said(resolution, RESOLUTIONS), said(effective, logic.OUTCOMES), names)], names=RESOLVED.names)


def _flags(x: pa.Array) -> np.ndarray:
    """Truths of all findings as 0, 1 (unknown) and 2."""
    return np.where(np.asarray(x.is_null()), 1, 2 * np.asarray(x.fill_null(False).cast(pa.int8()))).astype(np.int8)


def _outcomes(x: pa.Array) -> np.ndarray:
    return np.asarray(pc.index_in(x, pa.array(logic.OUTCOMES)).fill_null(REVIEW)).astype(np.int8)


def _in_parts(pack: Relations, one, columns: list[pa.Array]) -> pa.Array:
    step = max(1, CELLS // max(1, len(pack.names) + len(pack.source)))
    made = [one(_Cases(pack, columns[0].slice(i, step)), *[c.slice(i, step) for c in columns[1:]]) for i in range(0, len(columns[0]), step)]
    return pa.concat_arrays(made) if made else pa.array([], pa.struct([("resolution", pa.list_(pa.string())), ("effective", pa.list_(pa.string())), ("related", pa.list_(pa.list_(pa.string())))]))


def _overrides(c: _Cases, applies: pa.Array, reached: pa.Array, outcome: pa.Array, targets: pa.Array, truths: pa.Array) -> pa.Array:
    p = c.pack
    acts_if = c.matrix((_flags(applies.flatten()) == 2) & (_flags(reached.flatten()) == 2)) > 0
    effective = c.matrix(_outcomes(outcome.flatten()))
    # Truths of the edges: the finding's map at the edge's target; what is not there is unknown.
    entries = targets.flatten()
    owner = np.repeat(np.arange(len(entries)), entries.value_lengths().fill_null(0).to_numpy())
    target, values = pc.index_in(entries.flatten(), p.names), _flags(truths.flatten().flatten())
    back = np.full(int(c.sizes.sum()), -1, np.int64)
    back[c.known] = np.arange(len(c.known))
    good = ~np.asarray(target.is_null()) & (back[owner] >= 0)
    r = max(1, len(p.names))
    edge_key = p.source * r + p.target
    order = np.argsort(edge_key)
    finding = back[owner[good]]
    asked = c.rule[finding] * r + np.asarray(target.filter(pa.array(good))).astype(np.int64)
    spot = np.minimum(np.searchsorted(edge_key[order], asked), max(0, len(order) - 1))
    hit = edge_key[order][spot] == asked if len(order) else np.zeros(len(asked), bool)
    edge = np.ones((len(p.source), c.n), np.int8)
    if hit.any():
        edge[order[spot[hit]], c.case[finding[hit]]] = values[good][hit]
    unsure, taken = np.zeros(edge.shape, bool), np.zeros(edge.shape, bool)
    into_unsure, into_taken = np.zeros(effective.shape, bool), np.zeros(effective.shape, bool)
    starts = np.flatnonzero(np.diff(p.level, prepend=-1))
    for low, high in zip(starts, np.append(starts[1:], len(p.level))):
        e = slice(low, high)
        s, t = p.source[e], p.target[e]
        # Sources of this level have met all that overrides them.
        now = np.where(into_unsure[s], REVIEW, np.where(into_taken[s], NOT_APPLICABLE, effective[s]))
        active = acts_if[s] & (now != NOT_APPLICABLE) & (edge[e] > 0)
        unsure[e], taken[e] = active & (edge[e] == 1), active & (edge[e] == 2)
        first = np.flatnonzero(np.diff(t, prepend=-1))
        into_unsure[t[first]] |= np.logical_or.reduceat(unsure[e], first, axis=0)
        into_taken[t[first]] |= np.logical_or.reduceat(taken[e] | unsure[e], first, axis=0)
    uncertain = into_unsure.copy()
    np.logical_or.at(uncertain, p.source, unsure)
    overridden = np.zeros(effective.shape, bool)
    np.logical_or.at(overridden, p.target, taken)
    bad = np.broadcast_to(p.invalid[:, None], effective.shape)
    resolution = np.where(bad, INVALID, np.where(uncertain, UNCERTAIN, np.where(overridden, OVERRIDDEN, UNCHANGED)))
    effective = np.where(bad | uncertain, REVIEW, np.where(overridden, NOT_APPLICABLE, effective))
    e, k = np.nonzero(unsure)
    triples = [(p.source[e], k, p.target[e]), (p.target[e], k, p.source[e])]
    e, k = np.nonzero(taken)
    alone = ~uncertain[p.target[e], k]
    triples.append((p.target[e][alone], k[alone], p.source[e][alone]))
    e, k = np.nonzero((c.place[p.around[0]] >= 0) & (c.place[p.around[1]] >= 0))
    triples.append((p.around[0][e], k, p.around[1][e]))
    return c.lists(resolution, effective, [tuple(x[c.place[t[0], t[1]] >= 0] for x in t) for t in triples])


def declared_links(p: Relations, applies: np.ndarray, there: np.ndarray, fine: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rule, case and other rule of the declared conflicts that hold."""
    a, b = p.declared
    e, k = np.nonzero(fine[a] & fine[b])
    return [(a[e], k, b[e]), (b[e], k, a[e])]


def deontic_links(p: Relations, applies: np.ndarray, there: np.ndarray, fine: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for norms: stars between prohibitions and the least obligation or permission of a norm, and back.

    The star's centre is the least of all that apply, also if it then turns out uncertain.
    """
    out = []
    for pair in p.norms:
        for own, other in (pair, pair[::-1]):
            here = applies[other] & there[other]
            centre = other[here.argmax(axis=0)]
            linked = fine[own] & applies[own] & (here.any(axis=0) & fine[centre, np.arange(fine.shape[1])])
            e, k = np.nonzero(linked)
            out += [(own[e], k, centre[k]), (centre[k], k, own[e])]
    return out


def _conflicts(kinds, c: _Cases, applies: pa.Array, resolution: pa.Array, effective: pa.Array, related: pa.Array) -> pa.Array:
    how = np.asarray(pc.index_in(resolution.flatten(), pa.array(RESOLUTIONS)).fill_null(0)).astype(np.int8)
    how, now = c.matrix(how, INVALID), c.matrix(_outcomes(effective.flatten()))
    there = (now != NOT_APPLICABLE) & (how != INVALID)
    links = [x for kind in kinds for x in kind(c.pack, c.matrix(_flags(applies.flatten())) == 2, there, there & (how != UNCERTAIN))]
    hit = np.zeros(now.shape, bool)
    for rule, case, _ in links:
        hit[rule, case] = True
    # What a finding was related to stays.
    old = related.flatten()
    owner = np.repeat(np.arange(len(old)), old.value_lengths().fill_null(0).to_numpy())
    back = np.full(len(old), -1, np.int64)
    back[c.known] = np.arange(len(c.known))
    other = pc.index_in(old.flatten(), c.pack.names)
    good = ~np.asarray(other.is_null()) & (back[owner] >= 0)
    finding = back[owner[good]]
    links.append((c.rule[finding], c.case[finding], np.asarray(other.filter(pa.array(good))).astype(np.int64)))
    return c.lists(np.where(hit, CONFLICT, how), np.where(hit, REVIEW, now), links)


#: One pack, or a dict from pack to packs with the cases' column that names it.
Packs = Pack | dict[str, Pack]


def _resolver(packs: dict[str, Relations], one):
    @F.arrow_udf(RESOLVED)
    def run(*columns: pa.Array) -> pa.Array:
        names = columns[0].to_numpy(zero_copy_only=False)
        made, order = [], []
        for name in np.unique(names):
            rows = np.flatnonzero(names == name)
            made.append(_in_parts(packs[name], one, [x.take(pa.array(rows)) for x in columns[1:]]))
            order.append(rows)
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order)))) if made else _in_parts(next(iter(packs.values())), one, list(columns[1:]))

    return run.asNondeterministic()  # a barrier: else it would be written out wherever its answers are used


def _resolved(cases: DataFrame, source: str, pack: Packs, by: str | None, one, columns: list[Column]) -> DataFrame:
    """``cases`` with ``resolved``, made of the findings of ``source`` and the answers of ``one``."""
    packs = {k: p.arrays for k, p in (pack.items() if isinstance(pack, dict) else [("", pack)])}
    rows = cases.withColumn("_answer", _resolver(packs, one)(F.col(by).cast("string") if by else F.lit(""), *columns))
    entry = lambda x, i: F.struct(*[x[c].alias(c) for c in ("rule_id", "applies", "outcome")], *[F.get(f"_answer.{c}", i).alias(c) for c in RESOLVED.names])
    return rows.withColumn("resolved", F.filter(F.transform(source, entry), lambda x: x["resolution"].isNotNull())).drop("_answer")


def apply_overrides(cases: DataFrame, pack: Packs, by: str | None = None) -> DataFrame:
    """Adds ``resolved`` to rows of ``by_case`` or ``evaluate_rules``: an array with ``rule_id``, ``resolution``,
    ``effective``, ``related`` and what the finding said.

    Level by level: an active source (it applies, and its effect is not NOT_APPLICABLE)
    whose edge is unknown makes both ends uncertain; one whose edge is true takes
    its target out.  Rules of invalid components get INVALID and REVIEW.  Findings of rules that the
    pack lacks are left out.
    """
    columns = [F.col(f"found.{c}") for c in ("rule_id", "applies", "reached", "outcome")]
    maps = [F.transform("found", lambda x: F.map_keys(x["override_truths"])), F.transform("found", lambda x: F.map_values(x["override_truths"]))]
    return _resolved(cases, "found", pack, by, _overrides, [*columns, *maps])


def apply_conflicts(cases: DataFrame, pack: Packs, *kinds, by: str | None = None) -> DataFrame:
    """Rules with a link become CONFLICT_REVIEW; the others of the link are related.

    ``kinds``: ``declared_links``, ``deontic_links`` or both; links of all kinds are found before any counts.
    """
    columns = [F.col(f"resolved.{c}") for c in ("rule_id", "applies", "resolution", "effective", "related")]
    return _resolved(cases, "resolved", pack, by, functools.partial(_conflicts, kinds), columns)


def resolve_findings(cases: DataFrame, pack: Packs, by: str | None = None) -> DataFrame:
    """Overrides, then declared and deontic conflicts, on rows of ``by_case`` or ``evaluate_rules``."""
    return apply_conflicts(apply_overrides(cases, pack, by), pack, declared_links, deontic_links, by=by)


def exploded(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """A row for each case and rule of ``resolved``."""
    rows = cases.select(case, F.explode("resolved").alias("x"))
    return rows.select(case, *[F.col(f"x.{c}").alias(c) for c in ("rule_id", "applies", "outcome", "resolution", "effective", "related")])


def common_date(findings: DataFrame, case: str = "case_id", date: str = "evaluation_date") -> DataFrame:
    """``(case, valid)``: whether all findings of a case have one evaluation date."""
    return findings.groupBy(case).agg((F.count_distinct(F.coalesce(F.col(date).cast("string"), F.lit(""))) == 1).alias("valid"))
