"""Hashes of words and of runs of words, for whole batches of texts at a time.

A word is a run of bytes other than U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

import numpy as np

from .common import mix

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32


#: Bytes whose words are hashed at a time; a longer word is carried from piece to piece.
PIECE = 1 << 20


def _number(places: np.ndarray, seed: int) -> np.ndarray:
    """Odd 64-bit numbers."""
    return mix((places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BYTES, PLACES, RUNS = _number(np.arange(256), 1), _number(np.arange(1024), 2), _number(np.arange(64), 3)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text by text, and the number of words of each text.

    A word's hash is a sum over its bytes, so that a word of any length is taken in pieces.
    """
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    open_sum, open_size, open_start = np.zeros(1, np.uint64), 0, 0
    for low in range(0, len(buffer), PIECE):
        part = buffer[low : low + PIECE]
        if lower:
            part = LOWERED[part]
        blank = BLANK[part]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            if open_size:
                found.append((open_sum + np.uint64(open_size), np.array([open_start])))
            open_size = 0
            continue
        inside = part[~blank]
        sizes = ends - starts
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(len(inside)) - np.repeat(firsts, sizes)
        if open_size and starts[0] == 0:
            place[: sizes[0]] += open_size
        sums = np.add.reduceat(BYTES[inside] * (PLACES[place] if int(place.max()) < len(PLACES) else _number(place, 2)), firsts)
        starts = starts + low
        if open_size:
            if starts[0] == low:
                sums[:1] += open_sum
                sizes[0] += open_size
                starts[0] = open_start
            else:
                found.append((open_sum + np.uint64(open_size), np.array([open_start])))
        open_size = 0
        if not blank[-1]:
            open_sum, open_size, open_start = sums[-1:].copy(), int(sizes[-1]), int(starts[-1])
            sums, sizes, starts = sums[:-1], sizes[:-1], starts[:-1]
        found.append((sums + sizes.astype(np.uint64), starts))
    sums, starts = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return mix(sums), np.diff(np.searchsorted(starts, text_ends), prepend=0)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on; runs may reach into the next text."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += words[j : j + n] * RUNS[j]
    return mix(total + np.uint64(length))


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the index of its text and its place there."""
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
