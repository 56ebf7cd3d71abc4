"""Language-model scores by prediction by partial matching, beside a unigram base.

The model is a trie of byte contexts with the counts of the bytes that follow
them, gathered from all training texts.  A byte that a context has not seen
costs an escape (method C: as many counts as the context has distinct bytes)
to the context one byte shorter, where the bytes of the longer one are
excluded.  Texts begin with ``ORDER`` times the byte 0xFF, which UTF-8 never
uses, and end with one.

As the trained model does not change, the costs of frequent contexts (at least
``KEPT`` of all positions) are worked out once and scoring walks an automaton:
state and byte give the cost and next state.  Bytes behind other contexts are
looked up where all counts of their bucket are, so every context counts,
however rare; ``KEPT`` decides where a cost is worked out, not what it is.
``adaptive`` instead starts with an empty trie for each text.

The base adds log10((c + 0.5) / (N + 0.5 (V + 1))) over a text's words and its
end.  Counts and look-ups meet by 64-bit hashes of words, in packed arrays:
words of at least ``COMMON`` of all tokens (at most 1 / COMMON words) are sent
to all tasks, the others are looked up where their counts are.

Null texts count as empty: one token, the end.  Repeated rows each get their
own row.  A row is known by a 64-bit hash of its columns (chance of
any two alike: N^2 / 2^64).  Columns named as the new ones are replaced, others
stay.  Without training rows N is 0 and the model is uniform over bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hidden, raw, saved, small_batches, steps
from .word_hashes import word_hashes

ORDER = 5
EDGE = 0xFF
#: Least share of all positions of a context of the automaton; of all tokens of a word that every task knows.
KEPT, COMMON = 2.0**-18, 1e-6
BUCKET_BYTES, HELD = 16 << 20, 1_000_000
#: Contexts worked out at a time when an automaton is made.
CONTEXTS = 4096
PACKED = "bucket int, kind int, keys binary, rows binary, counts binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]
#: Kinds of packed rows.
WORDS, GRAMS, WANTED, FACTS, ASKED = range(5)


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with their edges, one behind the other, and where each one's first byte is."""
    before = bytes([EDGE]) * ORDER
    data = np.frombuffer(b"".join(x for t in texts for x in (before, t, before[:1])), np.uint8)
    sizes = np.array([len(t) + ORDER + 1 for t in texts], np.int64)
    return data, np.cumsum(sizes) - sizes + ORDER


def _codes(texts: list[bytes]) -> np.ndarray:
    """For every byte and end, the ORDER bytes before it and itself as one number."""
    data, first = _stream(texts)
    n = len(data) - ORDER
    code = np.zeros(n, np.uint64)
    for j in range(ORDER + 1):
        code = (code << np.uint64(8)) | data[j : j + n]
    use = np.ones(n, bool)
    for j in range(1, ORDER + 1):  # the edge bytes before a text are given, not predicted
        at = first - j - ORDER
        use[at[at >= 0]] = False
    return code[use]


def _pack(kind: int, bucket: np.ndarray, keys: np.ndarray, rows: np.ndarray | None, counts: np.ndarray | None) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    used = np.unique(bucket)
    cut = list(zip(np.searchsorted(bucket, used), np.searchsorted(bucket, used, "right")))
    parts = [[b""] * len(used) if x is None else [y.tobytes() for y in (x[order[a:b]].astype(t) for a, b in cut)] for x, t in ((keys, "<u8"), (rows, "<i8"), (counts, "<i8"))]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32())] + [pa.array(p, pa.binary()) for p in parts], names=NAMES)


def _gram_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the context, so that contexts of two bytes or more are whole."""
    return (((codes >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65521) % np.uint64(buckets)).astype(np.int32)


class _Counts:
    """Numbers and how often they came, merged now and then."""

    def __init__(self) -> None:
        self.fresh: list[np.ndarray] = []
        self.n = 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.fresh.append(keys)
        self.n += len(keys)
        if self.n >= HELD:
            self.merge()

    def merge(self) -> None:
        if self.fresh:
            keys, counts = np.unique(np.concatenate(self.fresh), return_counts=True)
            self.fresh, self.n = [], 0
            self.keys, self.counts = _merged(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _gather(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, n = _Counts(), _Counts(), 0

        def send() -> Iterator[pa.RecordBatch]:
            for kind, found in ((WORDS, words), (GRAMS, grams)):
                found.merge()
                if len(found.keys):
                    bucket = (found.keys % np.uint64(buckets)).astype(np.int32) if kind == WORDS else _gram_bucket(found.keys, buckets)
                    yield _pack(kind, bucket, found.keys, None, found.counts)
                found.__init__()

        for batch in steps(batches, "text"):
            texts = [t or b"" for t in raw(batch.column("text"))]
            words.add(word_hashes(texts, lower=True)[0])
            grams.add(_codes(texts))
            n += len(texts)
            if len(words.keys) + len(grams.keys) > 2 * HELD:
                yield from send()
        yield from send()
        if n:  # the texts themselves, as a count without keys
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([FACTS], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([np.int64(n).tobytes()], pa.binary())], names=NAMES)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket and kind; rows come sorted by these."""
    at, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            counts = np.concatenate([np.frombuffer(c, "<i8") for _, c in held])
            keys = np.concatenate([np.frombuffer(k, "<u8") for k, _ in held])
            keys, counts = _merged(keys, counts) if at[1] != FACTS else (keys, counts.sum(keepdims=True))
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([keys.astype("<u8").tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=NAMES)
            held.clear()

    for batch in batches:
        for b, kind, k, c in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (b, kind) != at:
                yield from close()
                at = b, kind
            held.append((k, c))
    yield from close()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.frombuffer(c, "<i8") for c in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([len(c) for c in counts], pa.int64())], names=["kind", "total", "many"])


def _choose(kind: int, least: float):
    """Keys with at least this count; of context counts, all that follow such contexts by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, counts = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                if kind == WORDS:
                    keep = counts >= least
                    found = [(0, keys[keep], counts[keep])]
                else:
                    found = []
                    for order in range(2, ORDER + 1):
                        own, n = _merged(keys & np.uint64((1 << 8 * (order + 1)) - 1), counts)
                        context = own >> np.uint64(8)
                        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                        total = np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(n)))
                        keep = (total >= least) | (order == 2)  # shorter contexts are sums of these
                        found.append((order, own[keep], n[keep]))
                for order, own, n in found:
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([order], pa.int32()), pa.array([own.astype("<u8").tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["order", "keys", "counts"])

    return run


class Automaton:
    """Costs (log10 of probabilities) and next states for each kept context and byte."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> None:
        """``tables``: for each order of 2 or more, sorted keys (context and byte) and counts."""
        keys, n = tables.get(2, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        tables = dict(tables)
        for order in (1, 0):
            keys, n = _merged(keys & np.uint64((1 << 8 * (order + 1)) - 1), n)
            tables[order] = keys, n
        seen = np.unique(tables[0][0]).astype(np.int64)
        a = len(seen)
        self.column = np.full(256, a, np.int64)  # the last column stands for all unseen bytes
        self.column[seen] = np.arange(a)
        unseen = 256 - a
        contexts, costs, rest = [], [], []
        above = None
        for order in range(ORDER + 1):
            keys, n = tables.get(order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            context = keys >> np.uint64(8)
            own, row = np.unique(context, return_inverse=True)
            if order == 0 and not len(own):
                own = np.zeros(1, np.uint64)
            table = np.zeros((len(own), a + 1), np.float32)
            table[row, self.column[(keys & np.uint64(0xFF)).astype(np.int64)]] = n
            keep = table.sum(axis=1, dtype=np.float64) >= least if order else np.ones(len(own), bool)
            own, table = own[keep], table[keep]
            has = table > 0
            total, distinct = table.sum(axis=1, dtype=np.float64), has.sum(axis=1)
            size = np.maximum(1, total + distinct)[:, None]
            if order == 0:
                # Behind the last escape: unseen bytes share alike.
                q = np.zeros_like(table)
                q[:, a] = 1 / max(1, unseen)
                escape = (distinct / size[:, 0])[:, None] if a else np.ones((1, 1))
            else:
                up = np.searchsorted(above[0], own & np.uint64((1 << 8 * (order - 1)) - 1))
                escape = (distinct / size[:, 0])[:, None]
                q = np.empty_like(table)
                for low in range(0, len(own), CONTEXTS):
                    at = slice(low, low + CONTEXTS)
                    u_table, u_q = above[1][up[at]], above[2][up[at]]
                    u_has = u_table > 0
                    left = np.where(has[at], 0, u_table)
                    more = (u_has.sum(axis=1) - distinct[at])[:, None]
                    d = left.sum(axis=1, dtype=np.float64)[:, None] + more
                    q[at] = np.where(has[at], 0, np.where(u_has, left / np.maximum(1, d), np.where(d > 0, more / np.maximum(1, d), 1) * u_q))
            p = np.empty_like(table)
            for low in range(0, len(own), CONTEXTS):
                at = slice(low, low + CONTEXTS)
                p[at] = np.log10(np.maximum(np.where(has[at], table[at] / size[at], escape[at] * q[at]), 1e-30))
            contexts.append(own)
            costs.append(p)
            above = own, table, q
        offsets = np.cumsum([0] + [len(c) for c in contexts])
        self.width = a + 1
        # States from here on have all ORDER bytes; shorter ones may hide a rare longer context.
        self.full = offsets[ORDER] if a and least > 1 else 0
        self.cost = np.concatenate(costs).ravel()
        self.next = np.zeros((offsets[-1], self.width), np.int32)
        symbols = np.append(seen, 0).astype(np.uint64)
        for order, own in enumerate(contexts):
            for low in range(0, len(own), CONTEXTS):
                longer = (own[low : low + CONTEXTS, None] << np.uint64(8)) | symbols[None, :]
                to = np.zeros(longer.shape, np.int32)
                for k in range(1, min(order + 1, ORDER) + 1):  # the longest kept context wins
                    if len(contexts[k]):
                        cut = longer & np.uint64((1 << 8 * k) - 1)
                        at = np.minimum(np.searchsorted(contexts[k], cut), len(contexts[k]) - 1)
                        to = np.where(contexts[k][at] == cut, at + offsets[k], to)
                to[:, a] = 0
                self.next[offsets[order] + low : offsets[order] + low + len(to)] = to
        self.next = self.next.ravel()

    def scores(self, texts: list[bytes], piece: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of each text's probability, its end included, but for positions behind rare
        contexts; of these the codes, and the text of each.

        The stream of texts is cut into pieces that are walked side by side; a
        state depends on ORDER bytes only, so each piece starts that much earlier.
        """
        data, first = _stream(texts)
        columns = self.column[data]
        rows = -(-len(data) // piece)
        padded = np.concatenate([np.zeros(ORDER, np.int64), columns, np.zeros(rows * piece - len(data), np.int64)])
        state = np.zeros(rows, np.int64)
        out, rare = np.empty((piece, rows), np.float32), np.empty((piece, rows), bool)
        start = np.arange(rows) * piece
        for j in range(-ORDER, piece):
            at = state * self.width + padded[start + j + ORDER]
            if j >= 0:
                out[j] = self.cost[at]
                rare[j] = state < self.full
            state = self.next[at].astype(np.int64)
        flat, open_ = out.T.ravel()[: len(data)].astype(np.float64), rare.T.ravel()[: len(data)]
        for j in range(1, ORDER + 1):  # the edge bytes before a text are given, not predicted
            open_[first - j] = False
        flat[open_] = 0
        total = np.concatenate([[0.0], np.cumsum(flat)])
        at = np.flatnonzero(open_)
        codes = np.zeros(len(at), np.uint64)
        for j in range(ORDER, -1, -1):
            codes = (codes << np.uint64(8)) | data[at - j]
        return total[first + np.array([len(t) for t in texts]) + 1] - total[first], codes, np.searchsorted(first, at, "right") - 1


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


class Contexts:
    """All contexts of a bucket, with those of one byte and none; costs as in the automaton."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels = []
        above = None
        for order in range(ORDER + 1):
            own, n = short[order] if order < 2 else _merged(keys & np.uint64((1 << 8 * (order + 1)) - 1), counts)
            context = own >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(own) else np.zeros(0, np.int64)
            total, distinct, shared = np.zeros(0), np.zeros(0), np.zeros(0)
            if len(own):
                total, distinct = np.add.reduceat(n, first), np.diff(first, append=len(n))
                if order:  # what the context one byte shorter has of this one's bytes
                    shared = np.add.reduceat(above[1][np.searchsorted(above[0], own & np.uint64((1 << 8 * order) - 1))], first)
            self.levels.append((own, n, context[first], total, distinct, shared))
            above = own, n
        self.unseen = max(1, 256 - len(short[0][0]))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's byte behind its context."""
        codes, back = np.unique(codes, return_inverse=True)
        p = np.ones(len(codes))
        live = np.arange(len(codes))  # codes whose byte has not been found yet
        begun = np.zeros(len(codes), bool)
        taken, taken_count = np.zeros(len(codes)), np.zeros(len(codes))  # bytes of the longer context
        for order in range(ORDER, -1, -1):
            own, n, contexts, total, distinct, shared = self.levels[order]
            gram = codes[live] & np.uint64((1 << 8 * (order + 1)) - 1)
            c, known = _at(contexts, gram >> np.uint64(8))
            i, c, gram = live[known], c[known], gram[known]
            g, found = _at(own, gram)
            more = distinct[c] - taken[i]
            d = total[c] - taken_count[i] + more
            # The longest known context escapes with all its bytes, shorter ones with those left.
            escape = np.where(begun[i], np.where(d > 0, more / np.maximum(1, d), 1), distinct[c] / np.maximum(1, d))
            p[i] *= np.where(found, n[g] / np.maximum(1, d) if len(n) else 0, escape)
            begun[i] = True
            taken[i], taken_count[i] = distinct[c], shared[c] if order else 0
            done = np.zeros(len(live), bool)
            done[known] = found
            live = live[~done]
        p[live] /= self.unseen
        return np.log10(np.maximum(p, 1e-30))[back]


def _ask(model: dict, common: tuple[np.ndarray, np.ndarray], n: int, v: int, ends: int, buckets: int):
    """Scores, and the sums over common words; other words and bytes behind rare contexts are sent to their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Automaton(model["tables"], model["least"])
        keys, counts = common
        logs = np.log10((np.append(counts, ends) + 0.5) / (n + 0.5 * (v + 1)))
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WANTED: [], ASKED: []}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                h, row = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                yield _pack(kind, (h % np.uint64(buckets)).astype(np.int32) if kind == WANTED else _gram_bucket(h, buckets), h, row, None)

        for batch in steps(batches, "text"):
            texts = [t or b"" for t in raw(batch.column("text"))]
            h, sizes = word_hashes(texts, lower=True)
            ids = batch.column("row").to_numpy()
            owner = np.repeat(np.arange(len(texts)), sizes)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            base = np.bincount(owner[known], logs[at[known]], len(texts)) + logs[-1]
            found = np.bincount(owner[known], minlength=len(texts)) + (ends > 0)
            sums, codes, asking = walk.scores(texts)
            facts = np.column_stack([base, sums])
            numbers = np.column_stack([sizes + 1, found])
            bucket = int(ids[0] % buckets)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([FACTS], pa.int32()), pa.array([facts.astype("<f8").tobytes()], pa.binary()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([numbers.astype("<i8").tobytes()], pa.binary())], names=NAMES)
            held[WANTED].append((h[~known], ids[owner[~known]]))
            held[ASKED].append((codes, ids[asking]))
            size += int((~known).sum()) + len(codes)
            if size >= HELD:
                yield from send()
                size = 0
        if size:
            yield from send()

    return run


def _answer(n: int, v: int, short: dict, buckets: int):
    """Each bucket: counts first, then the words and codes asked for; answers are sums by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams, contexts = none, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def bytes_asked() -> Iterator[pa.RecordBatch]:
            nonlocal contexts, size
            if held:
                contexts = contexts or Contexts(*grams, short)
                codes, rows = (np.concatenate(x) for x in zip(*held))
                held.clear()
                size = 0
                own, row = np.unique(rows, return_inverse=True)
                zero = np.zeros(len(own))
                yield from out(own, zero, zero, np.bincount(row, contexts.costs(codes), len(own)), zero, zero)

        pending: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def out(*answers: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            pending.append(answers)
            waiting += len(answers[0])
            if waiting >= HELD // 4:
                yield from send()

        def send() -> Iterator[pa.RecordBatch]:
            """Answers go back by row, so that those of a text meet again; first they are added up here."""
            nonlocal waiting
            if not pending:
                return
            rows, *sums = (np.concatenate(x) for x in zip(*pending))
            pending.clear()
            waiting = 0
            rows, own = np.unique(rows, return_inverse=True)
            copies, base, score, tokens, known = (np.bincount(own, x, len(rows)) for x in sums)
            group = (rows % buckets).astype(np.int32)
            order = np.argsort(group, kind="stable")
            used, first = np.unique(group[order], return_index=True)
            cut = list(zip(first, [*first[1:], len(order)]))
            pick = lambda x, t: pa.array([x[order[a:b]].astype(t).tobytes() for a, b in cut], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pick(rows, "<i8"), pick(copies, "<i8"), pick(base, "<f8"), pick(score, "<f8"), pick(tokens, "<i8"), pick(known, "<i8")], names=["bucket", "rows", "copies", "base", "score", "tokens", "known"])

        for batch in batches:
            for b, kind, k, r, c in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if b != at:
                    yield from bytes_asked()
                    at, keys, counts = b, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    grams, contexts = none, None
                if kind == WORDS:
                    keys, counts = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                    continue
                if kind == GRAMS:
                    grams = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                    continue
                rows = np.frombuffer(r, "<i8")
                if kind == ASKED:
                    held.append((np.frombuffer(k, "<u8"), rows))
                    size += len(rows)
                    if size >= HELD // 4:
                        yield from bytes_asked()
                    continue
                if kind == FACTS:
                    facts, numbers = np.frombuffer(k, "<f8").reshape(-1, 2), np.frombuffer(c, "<i8").reshape(-1, 2)
                    yield from out(rows, np.ones(len(rows)), facts[:, 0], facts[:, 1], numbers[:, 0], numbers[:, 1])
                    continue
                h = np.frombuffer(k, "<u8")
                i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                count = np.where(keys[i] == h, counts[i], 0) if len(keys) else np.zeros(len(h), np.int64)
                own, row = np.unique(rows, return_inverse=True)
                base = np.bincount(row, np.log10((count + 0.5) / (n + 0.5 * (v + 1))), len(own))
                zero = np.zeros(len(own))
                yield from out(own, zero, base, zero, zero, np.bincount(row[count > 0], minlength=len(own)))
        yield from bytes_asked()
        yield from send()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by text; a bucket's rows come together."""
    at, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            rows, copies, base, score, tokens, known = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate(("<i8", "<i8", "<f8", "<f8", "<i8", "<i8")))
            own, i = np.unique(rows, return_inverse=True)
            many = np.bincount(i, copies, len(own))  # rows that are alike in all columns
            add = lambda x: np.bincount(i, x, len(own)) / many
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(add(tokens).astype(np.int64)), pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(add(score))], names=["row", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for x in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if x[0] != at:
                yield from close()
                at = x[0]
            held.append(x[1:])
    yield from close()


def train(texts: DataFrame, buckets: int) -> tuple[DataFrame, dict]:
    """Counts of all texts (column ``text``): the packed table, and the model with its totals."""
    table = saved(texts.select("text").mapInArrow(_gather(buckets), PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_add_up, PACKED))
    totals = {r["kind"]: (r["total"], r["many"]) for r in table.mapInArrow(_totals, "kind int, total long, many long").groupBy("kind").agg(F.sum("total").alias("total"), F.sum("many").alias("many")).collect()}
    ends = totals.get(FACTS, (0, 0))[0]
    words, distinct = totals.get(WORDS, (0, 0))
    least = max(1.0, KEPT * totals.get(GRAMS, (0, 0))[0])
    tables = {}
    for row in table.where(F.col("kind") == GRAMS).mapInArrow(_choose(GRAMS, least), "order int, keys binary, counts binary").collect():  # bounded by KEPT
        tables.setdefault(row["order"], []).append((np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["counts"], "<i8")))
    tables = {order: _merged(*(np.concatenate(x) for x in zip(*parts))) for order, parts in tables.items()}
    short, low = {}, tables.get(2, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    for order in (1, 0):
        short[order] = low = _merged(low[0] & np.uint64((1 << 8 * (order + 1)) - 1), low[1])
    n, v = words + ends, distinct + (ends > 0)
    common = [(np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8")) for r in table.where(F.col("kind") == WORDS).mapInArrow(_choose(WORDS, max(1, COMMON * n)), "order int, keys binary, counts binary").collect()]  # at most 1 / COMMON words
    common = _merged(*(np.concatenate(x) for x in zip(*common))) if common else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return table, {"tables": tables, "short": short, "least": least, "n": n, "v": v, "ends": ends, "common": common}


def score(df: DataFrame, train_rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` to ``df``
    without its text; ``train_rows`` has a column ``text``."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    table, model = train(train_rows, buckets)
    small_batches(spark)
    inner, back = hidden(df, text)
    # A row is known by a hash of its columns that stays the same wherever it is worked out again.
    known_by = F.xxhash64(*[F.col(f"`{c}`") for c, t in inner.dtypes if "map<" not in t]).bitwiseAND(F.lit(2**63 - 1))
    numbered = inner.withColumn("row", known_by)
    asked = numbered.select("row", "text").mapInArrow(_ask({k: model[k] for k in ("tables", "least")}, model["common"], model["n"], model["v"], model["ends"], buckets), PACKED)
    both = asked.unionByName(table.where(F.col("kind").isin(WORDS, GRAMS)))
    answers = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer(model["n"], model["v"], model["short"], buckets), "bucket int, rows binary, copies binary, base binary, score binary, tokens binary, known binary")
    sums = answers.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "row long, n_tokens long, n_known long, base_score double, score double")
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c, name in zip(back, df.columns) if name != text and name not in new]
    return numbered.drop("text").join(sums, "row").select(*keep, "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 of a text's probability under a trie that learns as it goes; its end is included."""
    seen: dict[bytes, Counter] = {}
    history = bytes([EDGE]) * order
    total = 0.0
    for symbol in text + bytes([EDGE]):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            counts = seen.get(history[len(history) - k :])
            left = {s: c for s, c in counts.items() if s not in excluded} if counts else {}
            if not left:
                continue
            size = sum(left.values()) + len(left)
            if symbol in left:
                p *= left[symbol] / size
                break
            p *= len(left) / size
            excluded |= left.keys()
        else:
            p /= 256 - len(excluded)
        total += math.log10(p)
        for k in range(order + 1):
            seen.setdefault(history[len(history) - k :], Counter())[symbol] += 1
        history = (history + bytes([symbol]))[-order:] if order else b""
    return total


def adaptive(df: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """Adds ``adaptive_score`` to every row: each text by its own trie."""
    import pandas as pd

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: adaptive_score((t or "").encode(), order))

    return df.withColumn("adaptive_score", own(text))
