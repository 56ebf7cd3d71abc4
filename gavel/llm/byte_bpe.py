"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts is one array of code points.  A table maps code points to
classes, each class is a transition function of a small automaton, and the
functions are closed under composition (a finite monoid with a composition
table).  Composition is associative, so the automaton's state behind every
code point comes from a blocked prefix scan of table look-ups; boundaries
follow from neighbouring states.  No regular expression runs.  The slices
between boundaries go through a cache of pair merging.

Nulls encode like empty texts: no tokens.  Columns of the input other than
the text pass through; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import replace_columns, small_batches, steps

#: Code points that count as white space (Unicode White_Space); fixed values.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that may follow an apostrophe at a token's start; fixed values.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

# Classes of code points.
BREAK, SPACE, BLANK, NUMBER, OTHER, QUOTE, LETTER, SHORT, CH_R, CH_V, CH_L, CH_E = range(12)
# States behind a code point: FRESH before a text's first one, TICK an apostrophe
# that starts a token, TICK_x one letter behind it, ENDING a complete ending.
FRESH, IN_SPACE, IN_BLANK, IN_NUMBER, IN_OTHER, TICK, IN_LETTER, TICK_R, TICK_V, TICK_L, ENDING = range(11)
N_STATES = 11
PIECES_KEPT = 80_000
NO_PAIR = np.int32(2**31 - 1)
#: Slices of more bytes are merged one by one.
WIDEST = 64


def _next_state(state: int, kind: int) -> int:
    if kind == BREAK:
        return FRESH
    if kind in (SPACE, BLANK, NUMBER, OTHER):
        return {SPACE: IN_SPACE, BLANK: IN_BLANK, NUMBER: IN_NUMBER, OTHER: IN_OTHER}[kind]
    if kind == QUOTE:
        return IN_OTHER if state in (IN_OTHER, IN_SPACE, TICK) else TICK
    if state == TICK:
        return {SHORT: ENDING, CH_R: TICK_R, CH_V: TICK_V, CH_L: TICK_L}.get(kind, IN_LETTER)
    if (state in (TICK_R, TICK_V) and kind == CH_E) or (state == TICK_L and kind == CH_L):
        return ENDING
    return IN_LETTER


def _starts_token(before: int, kind: int, after: int) -> bool:
    """Whether a code point starts a token, white space and half-read endings apart."""
    if kind == BREAK or before in (FRESH, ENDING, IN_BLANK):
        return True
    if kind in (SPACE, BLANK):
        return before not in (IN_SPACE, IN_BLANK)
    if before == IN_SPACE:
        return False
    if kind == NUMBER:
        return before != IN_NUMBER
    if kind in (OTHER, QUOTE):
        return before not in (IN_OTHER, TICK)
    if before == TICK:
        return after != ENDING
    return before not in (IN_LETTER, TICK_R, TICK_V, TICK_L)


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Composition table (row: first applied), states by function, id of the identity, function of each class."""
    functions = [tuple(_next_state(s, k) for s in range(N_STATES)) for k in range(12)]
    known = {f: i for i, f in enumerate(dict.fromkeys(functions + [tuple(range(N_STATES))]))}
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
    all_ = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in all_] for f in all_], np.uint16)
    assert len(known) < 256
    by_class = np.array([known[f] for f in functions], np.uint16)
    return compose, np.array(all_, np.uint8), known[tuple(range(N_STATES))], by_class


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point; token starts by (state before, class, state after)."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    first = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    kinds[first == ord("L")] = LETTER
    kinds[first == ord("N")] = NUMBER
    kinds[WHITE] = BLANK
    kinds[0x20] = SPACE
    kinds[ord("'")] = QUOTE
    for c, k in (("s", SHORT), ("t", SHORT), ("m", SHORT), ("d", SHORT), ("r", CH_R), ("v", CH_V), ("l", CH_L), ("e", CH_E)):
        kinds[ord(c)] = k
    starts = np.array([[[_starts_token(b, k, a) for a in range(N_STATES)] for k in range(12)] for b in range(N_STATES)])
    return kinds, starts


def _prefix(functions: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix compositions: within blocks column by column, then over the blocks' totals."""
    compose, _, identity, _ = _monoid()
    m, n = len(compose), len(functions)
    flat = compose.ravel()
    if n <= width:
        width = max(1, n)
    rows = -(-n // width)
    grid = np.full(rows * width, identity, np.int32)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = flat[grid[j - 1] * m + grid[j]]
    if rows > 1:
        totals = _prefix(grid[-1], width)
        grid[:, 1:] = flat[totals[None, :-1] * m + grid[:, 1:]]
    return grid.T.ravel()[:n]


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions where tokens start; ``kinds`` ends with a BREAK, each BREAK is a token of its own."""
    _, outcome, _, by_class = _monoid()
    states = outcome[_prefix(by_class[kinds]), FRESH]
    before = np.empty_like(states)
    before[0], before[1:] = FRESH, states[:-1]
    starts = _tables()[1][before, kinds, states]
    white = (kinds == SPACE) | (kinds == BLANK)
    # The last of several white code points stands apart if more text follows.
    last = white[:-1] & ~white[1:] & (kinds[1:] != BREAK)
    inner = white[:-1] & ((before[:-1] == IN_SPACE) | (before[:-1] == IN_BLANK))
    starts[:-1][inner] = last[inner]
    # A letter behind an apostrophe starts a token unless the next one completes an ending.
    half = (before[:-1] == TICK) & np.isin(states[:-1], (TICK_R, TICK_V, TICK_L))
    starts[:-1][half] = states[1:][half] != ENDING
    return np.flatnonzero(starts)


def pre_tokenise(texts: list[str]) -> list[list[str]]:
    """The slices of every text, in order."""
    big = "\0".join(texts) + "\0"
    points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    kinds = _tables()[0][points]
    breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[breaks] = BREAK
    starts = piece_starts(kinds)
    bounds = np.searchsorted(starts, breaks)
    at = starts.tolist()
    at.append(len(big))
    slices = [big[a:b] for a, b in zip(at, at[1:])]
    out, low = [], 0
    for high in bounds.tolist():
        out.append(slices[low:high])
        low = high + 1  # the break itself
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PairTable:
    """Ids of all pairs of ids that join to a known id, for look-ups of whole arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [((left << 32) | right, i) for word, i in ranks.items() for k in range(1, len(word)) if (left := ranks.get(word[:k])) is not None and (right := ranks.get(word[k:])) is not None]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.ids = np.array([i for _, i in pairs] + [NO_PAIR], np.int32)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids; NO_PAIR where there is none (also for a negative id)."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys, self.ids[np.minimum(at, len(self.ids) - 1)], NO_PAIR)


def merge_many(pieces: list[bytes], table: PairTable) -> list[bytes]:
    """Ids (as bytes) of many slices of similar length: in each round every slice joins its
    adjacent pair of lowest rank, leftmost first, and scores its two new pairs."""
    rows, width = len(pieces), max(map(len, pieces))
    sizes = np.array([len(p) for p in pieces])
    ids = np.full((rows, width + 1), -1, np.int32)
    held = np.arange(width + 1) < sizes[:, None]
    ids[held] = table.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.minimum(np.arange(1, width + 2), width) + np.zeros((rows, 1), np.int32)
    before = np.arange(-1, width) + np.zeros((rows, 1), np.int32)
    scores = np.full((rows, width), NO_PAIR, np.int32)
    both = held[:, 1:]
    scores[both] = table.joined(ids[:, :-1][both], ids[:, 1:][both])
    live = np.arange(rows)
    while len(live):
        at = scores[live].argmin(axis=1)
        best = scores[live, at]
        going = best < NO_PAIR
        live, at, best = live[going], at[going], best[going]
        if not len(live):
            break
        gone = after[live, at]
        behind = after[live, gone]
        ids[live, at], ids[live, gone] = best, -1
        after[live, at] = behind
        before[live, behind] = at
        inside = gone < width
        scores[live[inside], gone[inside]] = NO_PAIR
        scores[live, at] = table.joined(best, ids[live, behind])
        ahead = before[live, at]
        some = ahead >= 0
        scores[live[some], ahead[some]] = table.joined(ids[live[some], ahead[some]], best[some])
    left = ids >= 0
    flat = ids[left].astype("<u4").tobytes()
    ends = (np.cumsum(left.sum(axis=1)) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, in n log n steps."""
    n = len(piece)
    ends, following, previous = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, version = [True] * n, [0] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = following[i]
        if j < n and (rank := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, version[i]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, seen = heapq.heappop(heap)
        if not alive[i] or version[i] != seen:
            continue
        j = following[i]
        ends[i], following[i], alive[j] = ends[j], following[j], False
        if following[j] < n:
            previous[following[j]] = i
        version[i] += 1
        offer(i)
        if (k := previous[i]) >= 0:
            version[k] += 1
            offer(k)
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Ranks with a cache from slices to ids as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.table = PairTable(self.ranks)
        self.cache: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            form = piece.encode()
            if (whole := self.ranks.get(form)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(form) > WIDEST:
                self.cache[piece] = np.array(_merge_long(form, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault(-(-len(form) // 8), []).append((piece, form))
        for group in groups.values():
            for (piece, _), ids in zip(group, merge_many([form for _, form in group], self.table)):
                self.cache[piece] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as bytes."""
        if len(self.cache) > PIECES_KEPT:
            self.cache.clear()
        slices = pre_tokenise(texts)
        self._learn(set().union(*slices).difference(self.cache))
        return [b"".join(map(self.cache.__getitem__, s)) for s in slices]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of every id (gaps are empty) and their lengths."""
    ranks = load_ranks(path)
    words = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        words[i] = word
    return words, np.array([len(w) for w in words], np.int32)


def _schema(df: DataFrame, new: list[T.StructField], drop: tuple[str, ...] = ()) -> T.StructType:
    names = {f.name for f in new} | set(drop)
    return T.StructType([f for f in df.schema.fields if f.name not in names] + new)


def encode(df: DataFrame, ranks_path: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``token_ids`` (little-endian 32-bit ids) and, with ``offsets``,
    ``token_ends`` (for each token the end of its bytes in the text, little-endian 32-bit)."""
    small_batches(df.sparkSession)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())] + [T.StructField("token_ends", T.BinaryType())] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        lengths = vocabulary(ranks_path)[1]
        for batch in steps(batches, text):
            ids = coder.encode([t or "" for t in batch.column(text).to_pylist()])
            more = {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())}
            if offsets:
                more["token_ends"] = pa.array([np.cumsum(lengths[np.frombuffer(i, "<u4")], dtype="<i4").tobytes() for i in ids], pa.binary())
            yield replace_columns(batch, [], **more)

    return df.mapInArrow(run, _schema(df, new))


#: Tokens whose bytes are placed at a time.
PLACED = 1 << 16


@functools.cache
def _placed(ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words behind each other, and where each word starts among them."""
    words, lengths = vocabulary(ranks_path)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths, dtype=np.int64) - lengths


def written(ids: np.ndarray, ends: np.ndarray, ranks_path: str) -> bytes:
    """The text of ids: each byte is taken from the token that its place falls into by the tokens' ends."""
    if not len(ids):
        return b""
    blob, starts = _placed(ranks_path)
    before = np.append(0, ends[:-1])
    if (ends - before != vocabulary(ranks_path)[1][ids]).any():
        raise ValueError("the ends of tokens do not fit their ids")
    out = []
    for low in range(0, len(ids), PLACED):
        part = slice(low, low + PLACED)
        out.append(blob[np.repeat(starts[ids[part]] - before[part], ends[part] - before[part]) + np.arange(before[low], ends[part][-1])].tobytes())
    return b"".join(out)


def round_trip(df: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``encode`` with offsets, and ``decoded``, in one pass: the bytes that the ids of a text stand
    for, each at the place that the offsets give it."""
    small_batches(df.sparkSession)
    new = [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("token_ids", T.BinaryType()), ("token_ends", T.BinaryType()), ("decoded", T.BinaryType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        lengths = vocabulary(ranks_path)[1]
        for batch in steps(batches, text):
            ids = coder.encode([t or "" for t in batch.column(text).to_pylist()])
            ends, decoded = [], []
            for i in ids:
                own = np.frombuffer(i, "<u4")
                ends.append(np.cumsum(lengths[own], dtype="<i8"))
                decoded.append(written(own, ends[-1], ranks_path))
            yield replace_columns(batch, [], n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()), token_ids=pa.array(ids, pa.binary()), token_ends=pa.array([e.astype("<i4").tobytes() for e in ends], pa.binary()), decoded=pa.array(decoded, pa.binary()))

    return df.mapInArrow(run, _schema(df, new))


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids`` stand for; null ids give no bytes."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary(ranks_path)[0].__getitem__
        for batch in steps(batches, ids):
            out = [b"".join(map(get, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(ids).to_pylist()]
            yield replace_columns(batch, [], **{to: pa.array(out, pa.binary())})

    return df.mapInArrow(run, _schema(df, [T.StructField(to, T.BinaryType())]))
