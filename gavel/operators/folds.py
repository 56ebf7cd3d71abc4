"""Work that goes through a key's records in order: folds, and sweeps over intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Intervals of a scope that start in one block, about; and most blocks of all scopes.
BLOCK, BLOCKS = 4096, 4096
#: Intervals of one part of a block, about.
CELL = 1024
#: Keys of one part of a scope whose intervals overlap much, about, and least parts of a scope that has so many times ``CELL`` keys.
KEYS, SPREAD = 16_384, 8
#: Most shuffle partitions of the groups of such parts.
MOST_DEALT = 2_000
OPEN = np.iinfo(np.int64).max


def ordered_fold(rows: DataFrame, by: list[str], order: list[str], reads: list[str], step: Callable, name: str) -> DataFrame:
    """Adds the text column ``name``: what ``step`` says of each record of a key, in ``order``.

    ``step(state, *values of reads)`` returns the next state and the text; a key's first state is None.
    Records come sorted, so that a task holds one state and one batch, however long a key is.
    """
    out = T.StructType([*[f for f in rows.schema.fields if f.name != name], T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            said = []
            values = zip(*(batch.column(c).to_pylist() for c in reads)) if reads else iter([()] * batch.num_rows)
            for k, v in zip(zip(*(batch.column(c).to_pylist() for c in by)), values):
                if k != key:
                    key, state = k, None
                state, text = step(state, *v)
                said.append(text)
            keep = [i for i, n in enumerate(batch.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(said, pa.string())], names=[*[batch.schema.names[i] for i in keep], name])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out)


def _met(found: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of the lesser and the greater key among the keys, of pairs of intervals that overlap, of which the later
    one is own to the block.  With ``same`` all meet all, else only those of the first part those of the second."""
    times = pa.chunked_array([*found.column("_s").chunks, *found.column("_e").chunks], found.schema.field("_s").type)
    place = pc.rank(times, tiebreaker="dense").to_numpy().astype(np.int64)
    start, end = place[: len(found)], np.where(found.column("_e").is_null().to_numpy(), np.iinfo(np.int64).max, place[len(found) :])
    keys = pc.unique(found.column("_k")).sort()
    key = pc.index_in(found.column("_k"), keys).to_numpy().astype(np.int64)
    own, first = (found.column(c).to_numpy() for c in ("_own", "_left"))
    left, right = (np.arange(len(found)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
    codes = []
    for low in range(0, len(left), CELL):
        a = left[low : low + CELL, None]
        later = np.where(start[a] > start[right], own[a], own[right])
        x, y = np.nonzero(later & (key[a] != key[right]) & (start[a] < end[right]) & (start[right] < end[a]))
        p, q = key[a[x, 0]], key[right[y]]
        codes.append(np.unique(np.minimum(p, q) * len(keys) + np.maximum(p, q)))
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    return code // max(1, len(keys)), code % max(1, len(keys)), keys


class _Sweep:
    """Which keys of two parts of a scope (or of one) have intervals that overlap, of intervals in the order of their starts.

    It holds a bit for each pair of keys and the end of each key's last stretch, however many intervals there are.  Two stretches
    that overlap do so at the start of the later one, so only those that start are compared.
    """

    def __init__(self, same: bool) -> None:
        self.same, self.listed, self.keys = same, ([], []), None

    def name(self, side: int, keys: pa.Array) -> None:
        self.listed[side].append(keys)

    def begin(self) -> None:
        left, right = (pa.concat_arrays(x) if x else None for x in self.listed)
        self.keys = [left, left if self.same else right]
        sizes = [0 if k is None else len(k) for k in self.keys]
        self.ends = [np.full(n, np.iinfo(np.int64).min) for n in sizes[: 1 if self.same else 2]]
        self.met = [np.zeros((n, -(-m // 8)), np.uint8) for n, m in list(zip(sizes, sizes[::-1]))[: len(self.ends)]]
        if self.same:
            self.ends, self.met = self.ends * 2, self.met * 2

    def go(self, sides: np.ndarray, keys: pa.Array, starts: np.ndarray, lasts: np.ndarray) -> None:
        """``lasts`` are the last places that an interval covers, as ends are not."""
        if self.keys is None:
            self.begin()
        place = np.zeros(len(sides), np.int64)
        for side in (0, 1):
            if len(own := np.flatnonzero(sides == side)):
                place[own] = pc.index_in(keys.take(pa.array(own)), self.keys[side]).to_numpy()
        ends, met = self.ends, self.met
        for side, i, start, last in zip(sides.tolist(), place.tolist(), starts.tolist(), lasts.tolist()):
            if ends[side][i] < start:
                met[side][i] |= np.packbits(ends[1 - side] >= start)
                ends[side][i] = last
            elif ends[side][i] < last:
                ends[side][i] = last

    def pairs(self) -> Iterator[tuple[pa.Array, pa.ListArray]]:
        """Keys with the keys that they meet, each pair once."""
        if self.keys is None or any(k is None for k in self.keys):
            return
        n, m = len(self.keys[0]), len(self.keys[1])
        for low in range(0, n, 64):
            high = min(low + 64, n)
            found = np.unpackbits(self.met[0][low:high], axis=1, count=m) | np.unpackbits(self.met[1][:, low // 8 : -(-high // 8)], axis=1, count=high - low).T
            if self.same:
                found &= np.arange(m) > np.arange(low, high)[:, None]
            others = [np.flatnonzero(row) for row in found]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in others])]).astype(np.int32)
            if offsets[-1]:
                yield self.keys[0].slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets), self.keys[1].take(pa.array(np.concatenate(others))))


def _numbers(times: pa.Array) -> np.ndarray:
    kind = times.type
    return (times.cast(pa.int32()) if pa.types.is_date32(kind) else times).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _pairs_by_keys(rows: DataFrame, scope: list[str], groups: int) -> DataFrame:
    """``(*scope, _x, _y)``: the pairs of ``rows`` with ``_parts``, the parts that the keys of their scope are dealt into.  Any two
    parts are a group of their own, which alone tells their pairs: these are never shuffled, but an interval goes to as many groups as
    its scope has parts.  A group's keys come first, with a null start, then its intervals as they start."""
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("_s", "_e")]
    rows = rows.unionByName(rows.select(*scope, "_k", "_parts").distinct().select("*", *none))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_k"), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.select(*scope, F.least("_part", "_other").alias("_a"), F.greatest("_part", "_other").alias("_b"), (F.col("_part") > F.col("_other")).alias("_right"), "_k", "_s", "_e")
    by = [*scope, "_a", "_b"]
    kind = rows.schema["_k"].dataType
    out = T.StructType([*[rows.schema[c] for c in scope], T.StructField("_x", kind), T.StructField("_many", T.ArrayType(kind))])

    def told(group: pa.RecordBatch, sweep: _Sweep) -> Iterator[pa.RecordBatch]:
        for keys, many in sweep.pairs():
            yield pa.RecordBatch.from_arrays([*[pa.repeat(group.column(c)[0], len(keys)) for c in scope], keys, many], names=[*scope, "_x", "_many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sweep = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).dictionary_encode().indices.to_numpy() for c in by]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(low, high - low)
                # One group has one text for its columns, also where a value does not equal itself.
                if last is None or any(str(last.column(c)[0]) != str(part.column(c)[0]) for c in by):
                    if last is not None:
                        yield from told(last, sweep)
                    sweep = _Sweep(part.column("_a")[0] == part.column("_b")[0])
                last = part.slice(0, 1)
                sides, named = part.column("_right").to_numpy(zero_copy_only=False).astype(np.int8), part.column("_s").is_null().to_numpy(zero_copy_only=False)
                for side in (0, 1):
                    if len(own := np.flatnonzero(named & (sides == side))):
                        sweep.name(side, part.column("_k").take(pa.array(own)))
                if len(own := np.flatnonzero(~named)):
                    ends = part.column("_e")
                    lasts = np.where(ends.is_null().to_numpy(zero_copy_only=False), OPEN, _numbers(ends) - 1)
                    sweep.go(sides[own], part.column("_k").take(pa.array(own)), _numbers(part.column("_s"))[own], lasts[own])
        if last is not None:
            yield from told(last, sweep)

    dealt = rows.repartition(groups, *by).sortWithinPartitions(*by, F.col("_s").asc_nulls_first())
    return dealt.mapInArrow(run, out).select(*scope, "_x", F.explode("_many").alias("_y"))


def overlapping_pairs(intervals: DataFrame, scope: list[str], key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``(*scope, key_a, key_b)``: pairs of different keys of a scope with intervals that overlap, once, the lesser first.

    A scope's time is cut into blocks at some of its starts.  Where few intervals are open at a cut, an interval goes to every block
    that it touches, and a block tells the pairs whose later one starts in it.  So disjoint intervals seldom
    meet, and an interval that spans a block has a partner in it for nearly each copy of it.  A block's
    intervals are dealt into parts of about ``CELL``, and any two parts are a group of their own, so that no task holds
    more than two parts and the pairs between them, also where starts are alike.
    Where more are open at a cut than the scope has parts of ``KEYS`` keys, blocks would tell the same pairs again and again; any two
    parts of keys are a group then, see ``_pairs_by_keys``.  That needs whole-number, date or timestamp times.
    Intervals are half open, a null end is open; those with a null start, key or scope, and empty ones, meet nothing.
    """
    rows = intervals.select(*scope, F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e")).dropna(subset=scope).where(F.col("_s").isNotNull() & F.col("_k").isNotNull() & (F.col("_e").isNull() | (F.col("_s") < F.col("_e"))))
    every = max(BLOCK, rows.count() // BLOCKS)
    cuts = rows.where(F.pmod(F.xxhash64(*scope, "_s", "_k"), F.lit(every)) == 0).groupBy(*scope).agg(F.array_sort(F.collect_set("_s")).alias("_cuts"))
    placed = rows.join(cuts, scope, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)))
    before = lambda p: F.size(F.filter("_cuts", p))
    first, last = before(lambda c: c <= F.col("_s")), F.when(F.col("_e").isNull(), F.size("_cuts")).otherwise(before(lambda c: c < F.col("_e")))
    placed = placed.withColumns({"_first": first, "_last": last, "_size": F.size("_cuts")}).drop("_cuts")
    fields = [rows.schema[c] for c in scope]
    kind = rows.schema["_k"].dataType
    pairs = F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b")
    found = []
    if all(isinstance(rows.schema[c].dataType, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)) for c in ("_s", "_e")):
        keys = F.approx_count_distinct("_k")
        parts = F.greatest(F.ceil(keys / KEYS), F.least(F.ceil(keys / CELL), F.lit(SPREAD)), F.lit(1)).cast("int")
        stats = placed.groupBy(*scope).agg(parts.alias("_parts"), F.try_divide(F.sum(F.col("_last") - F.col("_first")), F.max("_size")).alias("_open"))
        stats = stats.withColumn("_dense", F.col("_open").isNull() | (F.col("_open") > F.col("_parts")))
        groups, sparse = stats.agg(F.sum(F.when(F.col("_dense"), F.col("_parts") * (F.col("_parts") + 1) / 2).cast("long")), F.count_if(~F.col("_dense"))).first()
        if groups:
            found.append(_pairs_by_keys(rows.join(stats.where("_dense").select(*scope, "_parts"), scope), scope, max(1, min(groups, MOST_DEALT))).select(*scope, *pairs))
        if found and not sparse:
            return found[0]
        placed = placed.join(stats.where("_dense").select(*scope), scope, "left_anti") if found else placed
    blocks = placed.withColumn("_block", F.explode(F.sequence("_first", "_last"))).withColumn("_own", F.col("_first") == F.col("_block")).drop("_first", "_last", "_size")
    sizes = blocks.groupBy(*scope, "_block").agg(F.ceil(F.count("*") / CELL).cast("int").alias("_parts"))
    dealt = blocks.join(sizes, [*scope, "_block"]).withColumn("_part", F.pmod(F.xxhash64("_k", "_s", "_e"), F.col("_parts")).cast("int"))
    cells = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumns({"_a": F.least("_part", "_other"), "_b": F.greatest("_part", "_other"), "_left": F.col("_part") <= F.col("_other")}).drop("_part", "_other", "_parts")
    out = T.StructType([*fields, T.StructField(f"{key}_a", kind), T.StructField(f"{key}_b", kind)])

    def one(found: pa.Table) -> pa.Table:
        lesser, greater, keys = _met(found, found.column("_a")[0] == found.column("_b")[0])
        made = pa.table({f"{key}_{s}": keys.take(pa.array(p)) for s, p in (("a", lesser), ("b", greater))})
        for i, c in enumerate(scope):
            made = made.add_column(i, c, pa.chunked_array([pa.repeat(found.column(c)[0], len(made))]))
        return made

    return reduce(DataFrame.unionByName, [*found, cells.groupBy(*scope, "_block", "_a", "_b").applyInArrow(one, out).distinct()])
