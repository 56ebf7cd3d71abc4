"""Packs of rules as data: tables that a case's row is joined with, and arrays that are
folded for many cases and all rules at a time.

Rules never become expressions, so a plan has one size for eight rules or ten thousand.
A pack's different leaves are rows of parameters by fact key; its trees are arrays of
parents, level by level.  Truth is 0 (false), 1 (unknown) or 2 (true), so that ``all`` is the least of its
arguments, ``any`` the greatest, and ``not`` two less it.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INNER = ("all", "any", "not")
REASONS = ["MISSING_FACT", "MISSING_EVIDENCE", "UNRESOLVED_FACT", "TYPE_MISMATCH", "RESOURCE_LIMIT", "EVALUATED"]
EVALUATED = REASONS.index("EVALUATED")
#: The type of value that an operator asks for.
ASKS = dict.fromkeys(("contains", "contains_any", "matches"), "STRING") | dict.fromkeys(("greater_than", "less_than", "between"), "NUMBER") | dict.fromkeys(("date_before", "date_after", "date_between"), "DATE")
#: Bytes of tables up to which Spark is told to broadcast them; larger ones are joined by pack.
BROADCAST_BYTES = 64 << 20
#: Bytes of arrays that go to the tasks of one evaluation; more packs are evaluated one part after another.
ARRAY_BYTES = 64 << 20
#: Nodes times cases that are folded at a time.
CELLS = 1 << 24

_TEXTS, _FLAGS, _NUMBERS = ("op", "form", "asked", "s", "date_low", "date_high", "pattern", "mode"), ("b", "white", "fold", "with_low", "with_high"), ("n", "low", "high", "gap")
LEAF = pa.struct([("leaf", pa.int32()), ("longest", pa.int32()), ("many", pa.list_(pa.string())), *[(c, pa.string()) for c in _TEXTS], *[(c, pa.bool_()) for c in _FLAGS], *[(c, pa.float64()) for c in _NUMBERS]])
STRINGS = pa.list_(pa.string())
#: A pack's row: leaves by operator and fact key, and leaves over several facts under keys of their own.
PROGRAM = pa.schema([("pack", pa.string()), ("leaves", pa.map_(pa.string(), pa.list_(LEAF))), ("areas", pa.list_(pa.struct([("key", pa.string()), ("keys", STRINGS), ("gap", pa.float64())])))])
RULES = pa.schema([("pack", pa.string()), ("rules", pa.list_(pa.struct([("rule_id", pa.string()), ("applies", pa.int32()), ("satisfied", pa.int32()), ("exceptions", pa.list_(pa.int32())), ("overrides", pa.list_(pa.struct([("target", pa.string()), ("node", pa.int32())]))), ("first", pa.list_(STRINGS)), ("second", pa.list_(STRINGS)), ("third", pa.list_(STRINGS))])))])
NODES = pa.schema([("pack", pa.string()), ("node", pa.int32()), ("rule_id", pa.string()), ("section", pa.string()), ("path", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("op", pa.string()), ("groups", pa.list_(STRINGS))])


def leaf_row(leaf: dict, i: int) -> dict:
    """A leaf's parameters as ``LEAF`` has them, with its number."""
    form = leaf["form"]
    plain = lambda x: unicodedata.normalize(form, x) if form and x is not None else x
    row = {f.name: leaf.get(f.name) for f in LEAF} | {"leaf": i, "asked": leaf["value_type"] if leaf["op"] in ("eq", "not_eq") else ASKS.get(leaf["op"])}
    if leaf["op"] in ("eq", "not_eq", "contains", "contains_any") and row["asked"] == "STRING":
        row |= {"s": plain(row["s"]), "many": [plain(x) for x in row["many"] or []]}
    return row | {c: None if row[c] is None else float(row[c]) for c in _NUMBERS}


class Program:
    """One pack's rules, compiled from the rows of ``evaluate.flatten``."""

    def __init__(self, nodes: list[dict]) -> None:
        self.nodes = nodes
        unique: dict[str, int] = {}
        self.leaves: list[dict] = []
        index = {(n["rule_id"], n["section"], n["path"]): i for i, n in enumerate(nodes)}
        self.leaf = np.full(len(nodes), -1, np.int32)
        self.parent = np.full(len(nodes), -1, np.int32)
        kinds = []
        for i, n in enumerate(nodes):
            if n["parent"] is not None:
                self.parent[i] = index[n["rule_id"], n["section"], n["parent"]]
            kinds.append(INNER.index(n["op"]) if n["op"] in INNER else -1)
            if n["op"] not in INNER:
                own = {k: v for k, v in n.items() if k not in ("rule_id", "section", "path", "parent", "depth")}
                key = json.dumps(own, sort_keys=True, default=str)
                if key not in unique:
                    unique[key] = len(self.leaves)
                    self.leaves.append(own)
                self.leaf[i] = unique[key]
        kinds, depth = np.array(kinds, np.int8), np.array([n["depth"] for n in nodes], np.int32)
        with_children = np.unique(self.parent[self.parent >= 0])
        if (lonely := np.setdiff1d(np.flatnonzero(kinds >= 0), with_children)).size:
            raise ValueError(f"{nodes[lonely[0]]['op']} without arguments in rule {nodes[lonely[0]]['rule_id']}")
        self.levels = []
        for d in range(int(depth.max(initial=0)), 0, -1):
            children = np.flatnonzero(depth == d)
            children = children[np.argsort(self.parent[children], kind="stable")].astype(np.int32)
            starts = np.flatnonzero(np.diff(self.parent[children], prepend=-2))
            parents = self.parent[children[starts]]
            self.levels.append((children, starts.astype(np.int32), parents, [np.flatnonzero(kinds[parents] == k) for k in range(3)]))
        const = [leaf["op"] == "truth" for leaf in self.leaves]
        self.truth = np.array([2 * bool(leaf.get("b")) if c else 1 for leaf, c in zip(self.leaves, const)], np.int8)
        self.reason = np.array([EVALUATED if c else 0 for c in const], np.int8)

    def arrays(self) -> tuple:
        return self.leaf, self.levels, self.truth, self.reason

    @cached_property
    def groups(self) -> list[list[list[str]]]:
        """For each node the fact keys that its evidence rests on; those of one leaf over several facts go together."""
        own: list[dict] = [{} for _ in self.nodes]
        for i in sorted(range(len(self.nodes)), key=lambda i: -self.nodes[i]["depth"]):
            if self.leaf[i] >= 0:
                leaf = self.leaves[self.leaf[i]]
                keys = leaf.get("fact_keys") or ([leaf["fact_key"]] if "fact_key" in leaf else [])
                own[i] = {tuple(keys): None} if keys else {}
            if self.parent[i] >= 0:
                own[self.parent[i]].update(own[i])
        return [[list(k) for k in x] for x in own]

    def program_row(self, pack: str) -> dict:
        by_key: dict[str, list[dict]] = {}
        areas = []
        for i, leaf in enumerate(self.leaves):
            if leaf["op"] == "truth":
                continue
            row = leaf_row(leaf, i)
            key = leaf.get("fact_key")
            if leaf.get("fact_keys"):
                key = f"\0{i}"
                areas.append({"key": key, "keys": leaf["fact_keys"], "gap": float(leaf["gap"])})
            by_key.setdefault(f"{leaf['op']}\0{key}", []).append(row)
        return {"pack": pack, "leaves": list(by_key.items()), "areas": areas}

    def rules_row(self, pack: str) -> dict:
        roots: dict[str, dict[str, int]] = {}
        for i, n in enumerate(self.nodes):
            if n["parent"] is None:
                roots.setdefault(n["rule_id"], {})[n["section"]] = i
        union = lambda nodes: [list(k) for k in dict.fromkeys(tuple(g) for i in nodes for g in self.groups[i])]
        rows = []
        for rule, r in roots.items():
            exceptions = [i for s, i in r.items() if s.startswith("exception:")]
            overrides = [{"target": s.removeprefix("override:"), "node": i} for s, i in r.items() if s.startswith("override:")]
            rows.append({"rule_id": rule, "applies": r["applies_when"], "satisfied": r["satisfied_when"], "exceptions": exceptions, "overrides": overrides, "first": union([r["applies_when"]]), "second": union([r["applies_when"], *exceptions]), "third": union(r.values())})
        return {"pack": pack, "rules": rows}

    def node_rows(self, pack: str) -> list[dict]:
        return [{"pack": pack, "node": i, "groups": g} | {k: n[k] for k in ("rule_id", "section", "path", "parent", "depth", "op")} for i, (n, g) in enumerate(zip(self.nodes, self.groups))]


@dataclass
class Shared:
    """The different leaves of several packs under common numbers, and each pack's arrays by them."""

    leaves: list[dict]
    arrays: dict[str, tuple]


def shared(programs: dict[str, Program]) -> Shared:
    at: dict[str, int] = {}
    leaves: list[dict] = []
    numbers = {}
    for name, p in programs.items():
        own = []
        for leaf in p.leaves:
            key = json.dumps(leaf, sort_keys=True, default=str)
            if key not in at:
                at[key] = len(leaves)
                leaves.append(leaf)
            own.append(at[key])
        numbers[name] = np.array(own, np.int32)
    arrays = {}
    for name, p in programs.items():
        truth, reason = np.full(len(leaves), 1, np.int8), np.zeros(len(leaves), np.int8)
        truth[numbers[name]], reason[numbers[name]] = p.truth, p.reason
        leaf = np.full(len(p.leaf), -1, np.int32)
        leaf[p.leaf >= 0] = numbers[name][p.leaf[p.leaf >= 0]]
        arrays[name] = (leaf, p.levels, truth, reason)
    return Shared(leaves, arrays)


def table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """Rows of a pack's metadata as a table, marked for broadcast if small."""
    made = pa.Table.from_pylist(rows, schema)
    df = spark.createDataFrame(made)
    return F.broadcast(df) if made.nbytes <= BROADCAST_BYTES else df


def fold(arrays: tuple, row: np.ndarray, leaf: np.ndarray, truth: np.ndarray, reason: np.ndarray, cases: int) -> tuple[np.ndarray, np.ndarray]:
    """Truth and reason of every node (rows) in every case (columns) from the results of leaves."""
    leaf_of, levels, truths, reasons = arrays
    t, r = np.repeat(truths[:, None], cases, axis=1), np.repeat(reasons[:, None], cases, axis=1)
    t[leaf, row], r[leaf, row] = np.where(reason == EVALUATED, truth, 1), reason
    own = leaf_of >= 0
    states, why = np.zeros((len(leaf_of), cases), np.int8), np.full((len(leaf_of), cases), EVALUATED, np.int8)
    states[own], why[own] = t[leaf_of[own]], r[leaf_of[own]]
    for children, starts, parents, kinds in levels:
        below = states[children]
        least, most = np.minimum.reduceat(below, starts, axis=0), np.maximum.reduceat(below, starts, axis=0)
        for made, which in zip((least, most, 2 - least), kinds):
            states[parents[which]] = made[which]
    return states, why


def _fold_batch(programs: dict[str, tuple], names: np.ndarray, sizes: np.ndarray, flat: list[np.ndarray]) -> pa.Array:
    """Truths and reasons of all nodes of a batch of cases; ``flat``: leaves, truths and reasons, ``sizes`` of them for each case."""
    begin = np.cumsum(sizes) - sizes
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for name in np.unique(names):
        arrays = programs[name]
        rows = np.flatnonzero(names == name)
        step = max(1, CELLS // max(1, len(arrays[0])))
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            many = sizes[part]
            at = np.repeat(begin[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            states, why = fold(arrays, np.repeat(np.arange(len(part)), many), *[x[at] for x in flat], len(part))
            made.append((part, np.full(len(part), len(states)), np.stack([states.T.ravel(), why.T.ravel()])))
    if not made:
        return pa.array([], pa.struct([("truth", pa.list_(pa.int8())), ("reason", pa.list_(pa.int8()))]))
    order = np.argsort(np.concatenate([m[0] for m in made]))
    offsets = pa.array(np.append(0, np.cumsum(np.concatenate([m[1] for m in made]))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m[2][i] for m in made]))).take(pa.array(order)) for i in range(2)]
    return pa.StructArray.from_arrays(lists, names=["truth", "reason"])


_NODES = T.StructType([T.StructField("truth", T.ArrayType(T.ByteType())), T.StructField("reason", T.ArrayType(T.ByteType()))])


def folder(programs: dict[str, tuple]):
    """A vectorised function of columns: pack, and a case's leaves, truths and reasons as arrays."""

    @F.arrow_udf(_NODES)
    def run(pack: pa.Array, leaf: pa.Array, truth: pa.Array, reason: pa.Array) -> pa.Array:
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (leaf, truth, reason)]
        return _fold_batch(programs, pack.to_numpy(zero_copy_only=False), np.array(leaf.value_lengths().to_pylist(), np.int64), flat)

    return run.asNondeterministic()  # a barrier: else it would be written out wherever its answers are used


def folder_of_codes(programs: dict[str, tuple], numbers: list[int]):
    """The same of pack and one array, which has 4 times the reason plus the truth of each of the leaves ``numbers``."""
    own = np.array(numbers, np.int32)

    @F.arrow_udf(_NODES)
    def run(pack: pa.Array, codes: pa.Array) -> pa.Array:
        flat = codes.flatten().to_numpy(zero_copy_only=False)
        return _fold_batch(programs, pack.to_numpy(zero_copy_only=False), np.full(len(pack), len(own), np.int64), [np.tile(own, len(pack)), flat & 3, flat >> 2])

    return run.asNondeterministic()


def parts(programs: dict[str, Program]) -> list[dict[str, Program]]:
    """The packs in parts whose arrays are at most ``ARRAY_BYTES``, or one pack."""
    out: list[dict[str, Program]] = [{}]
    size = 0
    for name, p in programs.items():
        own = sum(x.nbytes for level in p.levels for x in level[:3]) + p.leaf.nbytes + p.truth.nbytes * 2
        if out[-1] and size + own > ARRAY_BYTES:
            out.append({})
            size = 0
        out[-1][name] = p
        size += own
    return out


def three(state: Column) -> Column:
    """A state as a truth, null where unknown."""
    return F.when(state == 2, True).when(state == 0, False)


def united(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
