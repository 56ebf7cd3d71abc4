"""Document fingerprints by consistent weighted sampling.

The terms of a text are its white-space separated words (A-Z lower-cased),
weighted by their counts.  For each of ``SAMPLES`` positions every term draws
r and c from Gamma(2, 1) and b from the unit interval, as functions of the
term and the position alone.  With t = floor(ln w / r + b) the term of least
ln c - r (t - b) - r is sampled, together with its t.  Two texts agree at a
position with a probability that equals their generalised Jaccard similarity
(sum of the lesser weights over sum of the greater ones).

A fingerprint is a string of 8 hexadecimal digits for each position.  A null
text is an empty one; texts without words have a fingerprint of zeros, alike
among themselves and unlike all others.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, steps

SAMPLES = 64
#: Quantiles of Gamma(2, 1) that a draw may take.
LEVELS = 1 << 16
BUCKET_BYTES = 8 << 20


@functools.cache
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(LEVELS) + 0.5) / LEVELS
    low, high = np.zeros(LEVELS), np.full(LEVELS, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def signatures(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) uint32: ``hashes`` and ``weights`` hold the distinct terms of one
    text behind the other, ``sizes`` their numbers; rows of texts without terms are 0."""
    quantile, log_quantile = _gamma()
    out = np.zeros((len(sizes), samples), np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    counts = sizes[full]
    starts = np.cumsum(counts) - counts
    log_w = np.log(weights).astype(np.float32)
    for k in range(samples):
        x = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = quantile[(x & np.uint64(LEVELS - 1)).astype(np.int64)]
        log_c = log_quantile[((x >> np.uint64(16)) & np.uint64(LEVELS - 1)).astype(np.int64)]
        b = (x >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_w / r + b)
        a = log_c - r * (t - b) - r
        least = np.repeat(np.minimum.reduceat(a, starts), counts)
        at = np.flatnonzero(a == least)
        at = at[np.searchsorted(at, starts)]  # the first of equals
        out[full, k] = mix(hashes[at] ^ (t[at].astype(np.int64).astype(np.uint64) << np.uint64(40)) ^ np.uint64(k)).astype(np.uint32) | np.uint32(1)
    return out


class Terms:
    """Word hashes, cached."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.cache) > 500_000:
            self.cache.clear()
        cache, hashes, weights, sizes = self.cache, [], [], []
        for text in texts:
            found = Counter(text.encode().lower().split())
            for word in found:
                if word not in cache:
                    cache[word] = xxhash.xxh3_64_intdigest(word)
            hashes += map(cache.__getitem__, found)
            weights += found.values()
            sizes.append(len(found))
        return np.array(hashes, np.uint64), np.array(weights, np.float64), np.array(sizes, np.int64)


def fingerprints(texts: list[str], terms: Terms | None = None) -> np.ndarray:
    return signatures(*(terms or Terms())(texts))


def written(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u4")]


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to every row."""
    from pyspark.sql import types as T

    from .common import replace_columns

    schema = T.StructType([f for f in df.schema.fields if f.name != "fingerprint"] + [T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in steps(batches, text):
            values = fingerprints([t or "" for t in batch.column(text).to_pylist()], terms)
            yield replace_columns(batch, [], fingerprint=pa.array(written(values), pa.string()))

    return df.mapInArrow(run, schema)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal positions."""
    return (a == b).mean(axis=-1)


def ordered_buckets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``bucket`` and ``copy``, dealt and sorted so that a partition streams whole
    buckets of neighbours in descending ``key``, each closed by a copy (``copy`` = 1) of the
    row that follows it: the first row of the next bucket, or of the first one.

    Cuts between buckets are quantiles of the key, about ``BUCKET_BYTES`` of text apart; the
    driver holds one number per bucket.  Null keys come last.
    """
    spark = df.sparkSession
    small_batches(spark)
    low = F.coalesce(F.col(key), F.lit(-(2**63)).cast("long"))
    df = df.withColumn(key, low)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    cuts = np.unique(np.array(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), "right").astype(np.int32))

    heads = df.groupBy(bucket_of(key).alias("bucket")).agg(F.max(key).alias("head")).orderBy("bucket").collect()
    goes_to = {h["head"]: heads[(i + 1) % len(heads)]["bucket"] for i, h in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, k.to_numpy(), "right")
        return pd.Series([[b] if (to := goes_to.get(x)) is None else [b, to] for b, x in zip(own.tolist(), k.tolist())])

    dealt = df.select(*df.columns, F.posexplode(targets(key)).alias("copy", "bucket"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", F.desc(key), F.sha2(F.coalesce(text, F.lit("")), 256))


def edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints every text and its edited form: the last floor(n / 3) code points replaced
    by the first as many of the next row in descending ``key`` (after the last: the first).

    Rows of one key follow each other in the order of their texts' hashes.  One row alone is
    its own neighbour.
    """
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held = Terms(), None
        for batch in steps(batches, text):
            keys, copies = batch.column(key).to_pylist(), batch.column("copy").to_pylist()
            texts = [t or "" for t in batch.column(text).to_pylist()]
            own = fingerprints(texts, terms)
            if held:
                keys, copies, texts, own = [held[0], *keys], [held[1], *copies], [held[2], *texts], np.vstack([held[3], own])
            held = keys[-1], copies[-1], texts[-1], own[-1]
            use = [i for i in range(len(keys) - 1) if not copies[i]]
            edited = []
            for i in use:
                n = len(texts[i])
                k = n // 3
                edited.append(texts[i][: n - k] + texts[i + 1][:k])
            changed = fingerprints(edited, terms)
            if use:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in use], pa.int64()), pa.array([len(texts[i]) for i in use], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        pa.array(written(own[use]), pa.string()), pa.array(written(changed), pa.string()),
                        pa.array(likeness(own[use], changed)), pa.array(likeness(own[use], own[[i + 1 for i in use]])),
                    ],
                    names=[c.split()[0] for c in columns.split(", ")],
                )

    rows = ordered_buckets(df.select(key, text), key, text).mapInArrow(run, columns)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
