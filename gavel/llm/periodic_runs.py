"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of consecutive words with smallest period q, at least
``LEAST`` words and ``TIMES`` periods long, that no neighbouring word extends
keeping the period.

1. Re-Pair: words become numbers, and pairs of neighbours that a text has twice or
   more become new symbols, the more frequent ones first, until no pair repeats.  Many
   texts are paired at a time, and in one round all pairs that are more frequent
   than those overlapping them are replaced.
2. Every run lies within one symbol and crosses its boundary, or crosses a boundary
   between symbols that are left.  One of its two sides then begins, or ends,
   with a square at that boundary.  Squares are sought once for each symbol, at the
   first place that derives it: their roots must begin where the words behind the
   boundary occur again.
3. What a symbol has is carried to all places that derive it, and stretched as far
   as the period holds; equal intervals are one run.

Words are known by 64-bit hashes, stretches are compared by 64-bit hashes of their
words.  Null texts have no words; texts without runs stay as they are apart from white
space.  Every row is judged alone, so ids may be null or repeated.  Columns named as the
new ones are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mix, raw, replace_columns, small_batches, steps
from .word_hashes import word_hashes

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Bytes of text whose words are paired at a time.
PAIRED_BYTES = 2 << 20
#: Words of the shortest stretch that is looked up; shorter roots are tried one by one.
GRAM = 4
BASE = 0x9E3779B97F4A7C15


class Text:
    """Words of several texts behind each other, with hashes of all stretches."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.power = np.ones(len(ids) + 1, np.uint64)
        np.cumprod(np.full(len(ids), BASE | 1, np.uint64), out=self.power[1:])
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64)) * self.power[:-1], out=self.sums[1:])

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, ``b`` being behind ``a``; at most ``most``."""
        low, high, shift = np.zeros(len(a), np.int64), most.astype(np.int64), self.power[b - a]
        start_a, start_b = self.sums[a], self.sums[b]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.sums[a + mid] - start_a) * shift == self.sums[b + mid] - start_b
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def grams(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each of ``at`` on."""
        return (self.sums[at + size] - self.sums[at]) * self.power[len(self.ids) - at]


class Places:
    """Where stretches of one size occur, among the positions ``at`` (rising)."""

    def __init__(self, text: Text, at: np.ndarray, size: int) -> None:
        hashes = text.grams(at, size)
        order = np.argsort(hashes, kind="stable")
        self.n, self.hashes, self.at = len(text.ids) + 1, hashes[order], at[order]
        self.block = np.cumsum(np.append(False, self.hashes[1:] != self.hashes[:-1])) if len(at) else np.zeros(0, np.int64)
        self.keys = self.block * self.n + self.at

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        return self.block[np.searchsorted(self.hashes, hashes)]

    def next(self, block: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place of each block not before ``least``; ``n`` if there is none."""
        i = np.searchsorted(self.keys, block * self.n + least)
        j = np.minimum(i, len(self.keys) - 1)
        return np.where((i < len(self.keys)) & (self.block[j] == block), self.at[j], self.n)


def _squares(t: Text, mid: np.ndarray, hi: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(which, q, reach)``: the words from ``mid[which]`` on have period q for ``reach`` words, two
    periods or more, up to ``hi``; no root is a power.  ``ends`` has the end of each word's text.

    Where a square reaches that far, roots up to the reach less the period would be powers.
    """
    room, beyond = (hi - mid) // 2, np.zeros(len(mid), np.int64)

    def tried(which: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = mid[which]
        reach = q + t.common(a, a + q, hi[which] - a - q)
        good = reach >= 2 * q
        which, q, reach = which[good], q[good], reach[good]
        beyond[which] = np.maximum(beyond[which], reach - q)
        return which, q, reach

    for q in range(1, GRAM):
        which = np.flatnonzero((room >= q) & (beyond < q))
        for i in range(q):
            which = which[t.ids[mid[which] + i] == t.ids[mid[which] + i + q]]
        yield tried(which, np.full(len(which), q))
    live, size = np.flatnonzero(room >= GRAM), GRAM
    at = np.arange(len(t.ids))
    while len(live):
        at = at[at + size <= ends[at]]
        if size > GRAM:  # only texts that are still looked at
            wanted = np.zeros(len(t.ids) + 1, bool)
            wanted[ends[mid[live]]] = True
            at = at[wanted[ends[at]]]
        places = Places(t, at, size)
        block = places.blocks(t.grams(mid[live], size))
        near = places.next(block, mid[live] + 1) - mid[live] <= room[live]
        live, block = live[near], block[near]
        which, own, least = live, block, mid[live] + np.maximum(size, beyond[live] + 1)
        while len(which):
            found = places.next(own, least)
            q = found - mid[which]
            good = (q < 2 * size) & (q <= room[which])
            which, own, q = which[good], own[good], q[good]
            yield tried(which, q)
            least = mid[which] + np.maximum(q, beyond[which]) + 1
        size *= 2
        live = live[room[live] >= size]


def _starts(ends: np.ndarray) -> np.ndarray:
    """Where the text of each word starts."""
    begin = np.flatnonzero(np.diff(ends, prepend=-1))
    return np.repeat(begin, np.diff(np.append(begin, len(ends))))


def _repair(ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(symbol, lo, mid, hi)``: all places that derive each new symbol, with its boundary; last, under
    symbols of their own, the boundaries that are left, between the ends of their texts."""
    n = len(ids)
    symbol, at, end = ids.astype(np.int64), np.arange(n), ends
    starts = _starts(ends)
    fresh, live = int(ids.max(initial=0)) + 1, np.ones(n, bool)
    while len(symbol):
        after = np.append(at[1:], n)
        inner = np.append(end[1:] == end[:-1], False)
        i = np.flatnonzero(live & inner)
        # A pair of numbers below fresh within a text, as one number; numbers are made small where they would not fit.
        texts = np.unique(end[i], return_inverse=True)[1] if len(i) else i
        if len(i) and (int(texts.max()) + 1) * fresh**2 >= 2**62:
            names, symbol = np.unique(symbol, return_inverse=True)
            fresh = len(names)
        _, pair, count = np.unique((texts * fresh + symbol[i]) * fresh + symbol[np.minimum(i + 1, len(symbol) - 1)], return_inverse=True, return_counts=True)
        twice = count[pair] >= 2
        i, pair = i[twice], pair[twice]
        score = np.zeros(len(symbol) + 2, np.int64)
        score[i + 1] = count[pair] * (len(count) + 1) + pair + 1
        own = score[1:-1]
        place = np.arange(len(symbol))
        first = np.maximum.accumulate(np.where(own != score[:-2], place, 0))  # of stretches of one pair every other is taken
        chosen = np.flatnonzero((own > 0) & (own >= score[:-2]) & (own >= score[2:]) & ((place - first) % 2 == 0))
        if len(chosen):
            name = fresh + np.unique(own[chosen], return_inverse=True)[1]
            yield name, at[chosen], at[chosen + 1], np.append(after, n)[chosen + 1]
            symbol = symbol.copy()
            symbol[chosen] = name
            fresh = int(name.max()) + 1
        live = own > 0
        live[chosen] = True
        live[np.maximum(chosen - 1, 0)] = True
        stays = np.ones(len(symbol), bool)
        stays[chosen + 1] = False
        # Texts without pairs to replace are done; the boundaries between their symbols are left.
        going = np.zeros(n + 1, bool)
        going[end[live & stays]] = True
        done = stays & ~going[end]
        place = at[done & (at > starts[at])]
        yield fresh + np.arange(len(place)), starts[place], place, ends[place]
        fresh += len(place)
        stays &= ~done
        symbol, at, end, live = symbol[stays], at[stays], end[stays], live[stays]


def find_runs(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of texts behind each other: ``ids`` has the words' numbers, ``ends``
    for each word where its text ends.  Sorted by start, then period."""
    n = len(ids)
    none = np.zeros(0, np.int64)
    parts = list(_repair(ids, ends))
    if not parts:
        return none, none, none
    symbol, lo, mid, hi = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, symbol))
    symbol, lo, mid, hi = symbol[order], lo[order], mid[order], hi[order]
    first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else none
    many = np.diff(np.append(first, len(symbol)))
    long = hi[first] - lo[first] >= LEAST
    first, many = first[long], many[long]
    a, b, c = lo[first], mid[first], hi[first]
    forth, back = Text(ids), Text(ids[::-1])
    starts = _starts(ends)
    found = []
    for which, q, reach in _squares(forth, b, c, ends):
        left = back.common(n - b[which] - q, n - b[which], b[which] - a[which])
        found.append((which, b[which] - left, b[which] + reach, q))
    for which, q, reach in _squares(back, n - b, n - a, (n - starts)[::-1]):
        right = forth.common(b[which] - q, b[which], c[which] - b[which])
        found.append((which, b[which] - reach, b[which] + right, q))
    which, s, e, q = (np.concatenate(x) for x in zip(*found))
    good = e - s >= np.maximum(LEAST, TIMES * q)
    which, s, e, q = which[good], s[good], e[good], q[good]
    # To all places that derive the symbol.
    times = many[which]
    entry = np.repeat(first[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    s, q = np.repeat(s - a[which], times) + lo[entry], np.repeat(q, times)
    e = s + q + forth.common(s, s + q, ends[s] - s - q)
    s = s - back.common(n - s - q, n - s, s - starts[s])
    out = np.unique(np.column_stack([s, q, e]), axis=0).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
NEW = {"n_words": T.LongType(), "runs": T.ArrayType(RUN), "collapsed_text": T.StringType()}


def runs(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``runs`` (start as a word's number from 0, length, period; by start, then
    period) and ``collapsed_text``: the words, joined by one space, that are in no run or among the
    first period of every run that has them."""
    small_batches(df.sparkSession)
    out = T.StructType([f for f in df.schema.fields if f.name not in NEW] + [T.StructField(k, t) for k, t in NEW.items()])
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in raw(batch.column(text))]
        hashes, counts = word_hashes(texts)
        ids = np.unique(hashes, return_inverse=True)[1]
        last = np.cumsum(counts)
        start, end, period = find_runs(ids, np.repeat(last, counts))
        base = last - counts
        edge = np.zeros(len(ids) + 1, np.int32)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, end, -1)
        stays = np.cumsum(edge)[:-1] == 0
        bounds = np.searchsorted(start, np.append(base, len(ids)))
        kept = []
        for i, t in enumerate(texts):
            words = t.split()
            if bounds[i] < bounds[i + 1]:
                words = [w for w, s in zip(words, stays[base[i] : last[i]].tolist()) if s]
            kept.append(b" ".join(words))
        own = np.repeat(base, np.diff(bounds))
        found = pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - start), pa.array(period)], fields=list(kind))
        return replace_columns(batch, [], n_words=pa.array(counts, pa.int64()), runs=pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found), collapsed_text=pa.array(kept, pa.binary()).cast(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, PAIRED_BYTES):
            yield one(batch)

    return df.mapInArrow(run, out)
