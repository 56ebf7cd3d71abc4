"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language in order.  A
document's own list is compared with each profile by the out-of-place
distance: the sum of rank differences, an absent n-gram counting as far as the
list is long.  Profiles come from all labelled rows given for training.

Texts are lower-cased; runs of other characters than letters become one word
boundary; n-grams do not reach over it.  A null text, an empty one and one
without letters gets ``und`` and score 0; so does every text if there is
nothing to learn from.  Ties go to the language that sorts first.  Repeated
rows each get their own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import LETTER, _tables
from .common import replace_columns, small_batches, steps

LONGEST = 3
#: Bits of a code point in a packed n-gram of the learning pass.
POINT = np.uint64(21)
UNKNOWN = "und"
#: Stands for a word boundary; 0 stays free for "no character", so that n-grams of different n differ.
BOUNDARY = np.uint64(1)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (BOUNDARY between words, never twice in a row) and the index of their text."""
    big = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    is_letter = _tables()[0][points] >= LETTER
    rows = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    points, rows, is_letter = points[keep], rows[keep], is_letter[keep]
    # Between two words one boundary is enough.
    twice = np.zeros(len(points), bool)
    twice[1:] = ~is_letter[1:] & ~is_letter[:-1] & (rows[1:] == rows[:-1])
    points = np.where(is_letter, points, BOUNDARY).astype(np.uint64)[~twice]
    return points, rows[~twice]


def grams(points: np.ndarray, rows: np.ndarray, bits: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed n-grams with their rows for each n: boundaries only at an end, and beside a letter."""
    letter = points != BOUNDARY
    code = points
    yield code[letter], rows[letter]
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << bits) | points[n - 1 :]
        same = rows[n - 1 :] == rows[: len(code)]
        for k in range(1, n - 1):
            same = same & letter[k : k + len(code)]
        if n == 2:
            same = same & (letter[:-1] | letter[1:])
        yield code[same], rows[: len(code)][same]


def _named(code: int) -> tuple[int, ...]:
    """Code points of an n-gram packed in the learning pass."""
    parts = [(code >> (21 * i)) & 0x1FFFFF for i in range(LONGEST)][::-1]
    return tuple(p for p in parts if p)


def learn(labelled: DataFrame, size: int = 300, text: str = "text", lang: str = "lang") -> dict[str, list[tuple[int, ...]]]:
    """The ``size`` most frequent n-grams of each language, from all rows with text and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in steps(batches, text):
            names = np.array(batch.column(lang).to_pylist(), object)
            texts = batch.column(text).to_pylist()
            for name in set(names):
                points, rows = letters([t for t, n in zip(texts, names) if n == name])
                codes, counts = np.unique(np.concatenate([c for c, _ in grams(points, rows, POINT)]), return_counts=True)
                if name in total:
                    both = np.concatenate([total[name][0], codes])
                    codes, at = np.unique(both, return_inverse=True)
                    counts = np.bincount(at, np.concatenate([total[name][1], counts])).astype(np.int64)
                total[name] = codes, counts
        for name, (codes, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[tuple[int, ...]]] = {}
    for row in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):  # languages x size rows
        profiles.setdefault(row["lang"], []).append(_named(row["gram"]))
    return profiles


class Profiles:
    """Profiles as arrays: an alphabet of their letters, their n-grams, a rank table."""

    def __init__(self, profiles: dict[str, list[tuple[int, ...]]]) -> None:
        self.names = sorted(profiles)
        self.size = max((len(p) for p in profiles.values()), default=0)
        points = sorted({c for p in profiles.values() for g in p for c in g if c != 1})
        self.points = np.array(points or [0], np.uint64)
        # 1 is a boundary, 2 any letter outside the alphabet.
        self.bits = np.uint64(max(2, int(len(points) + 3).bit_length()))
        number = {c: i + 3 for i, c in enumerate(points)} | {1: 1}
        code = lambda g: reduce(lambda a, b: (a << int(self.bits)) | b, [number[c] for c in g])
        ranks = {n: {code(g): r for r, g in enumerate(profiles[n])} for n in self.names}
        self.codes = np.array(sorted({c for r in ranks.values() for c in r} or {0}), np.uint64)
        self.ranks = np.array([[r.get(int(c), self.size) for c in self.codes] + [self.size] for r in ranks.values()], np.int32).reshape(len(self.names), len(self.codes) + 1)

    def classify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        points, rows = letters(texts)
        if not self.names or not (points != BOUNDARY).any():
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        points = np.where(points == BOUNDARY, 1, np.where(self.points[at] == points, at + 3, 2)).astype(np.uint64)
        found = list(grams(points, rows, self.bits))
        row_bits = np.uint64(max(1, len(texts).bit_length()))
        code_bits = np.uint64(LONGEST) * self.bits
        assert code_bits + row_bits <= 63
        keys, counts = np.unique((np.concatenate([r for _, r in found]).astype(np.uint64) << code_bits) | np.concatenate([c for c, _ in found]), return_counts=True)
        row = (keys >> code_bits).astype(np.int64)
        order = np.lexsort((keys, -counts, row))
        row, code = row[order], (keys & ((np.uint64(1) << code_bits) - np.uint64(1)))[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.size
        row, code, rank = row[top], code[top], rank[top]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        at = np.where(self.codes[at] == code, at, len(self.codes))
        used = np.bincount(row, minlength=len(texts))
        far = np.array([np.bincount(row, np.abs(rank - r[at]), len(texts)) for r in self.ranks])
        best = far.argmin(axis=0)
        score = 1 - far[best, np.arange(len(texts))] / np.maximum(1, used * self.size)
        return [self.names[b] if n else UNKNOWN for b, n in zip(best, used)], [float(min(1, max(0, s))) if n else 0.0 for s, n in zip(score, used)]


def identify(df: DataFrame, profiles: dict[str, list[tuple[int, ...]]], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (1: the profile's very order, 0: nothing in common)."""
    small_batches(df.sparkSession)
    drop = ("lang_pred", "score")
    schema = T.StructType([f for f in df.schema.fields if f.name not in drop] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for batch in steps(batches, text):
            names, scores = known.classify([t or "" for t in batch.column(text).to_pylist()])
            yield replace_columns(batch, list(drop), lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

    return df.mapInArrow(run, schema)


def accepted(df: DataFrame, min_score: float = 0.0) -> Column:
    """Rows that a filter by language keeps: those with a language, at ``min_score`` or above."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
