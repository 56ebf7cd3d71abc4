"""Removal of every byte of a long string that also starts elsewhere, by a logarithmic
family of suffix arrays.

A window is ``WINDOW`` bytes of one text.  All suffixes of all texts would be many times
the input, so suffixes are taken where a text's own bytes say so: of the ``GRAM``-byte
strings within a window the one with the least hash (the first of equal ones) is the
window's anchor.  Equal windows have their anchors at the same place, so a suffix at
each anchor, with the stretch of all windows that it is the anchor of, stands for them.

1. A batch (what a task reads at a time) gets a suffix array: its anchored suffixes, sorted by
   their gram, then by their stretch.  Neighbours that are equal in both are long matches.
2. Arrays are dealt by gram.  Each bucket keeps a family of sorted levels; an arriving
   array is merge-scanned against every level for matches, then becomes a level itself, and levels
   of like size merge, so that sizes grow geometrically.
3. Suffixes of one gram but different stretches may share some windows only (where a
   common passage begins or ends).  The windows of one suffix of each such stretch are then indexed
   in the same way, one by one.
4. Findings go back to their texts, which lose all bytes that they cover.

Suffixes are ordered by 64-bit hashes of their bytes, not by the bytes: only equality
over a known length matters, and a level then has no texts (chance of a false match for each
window: windows / 2^64).  Of a gram with more than ``MOST`` different stretches a level keeps
one; all other suffixes of that gram go to step 3, where equal windows are merged in each
task first, so that no gram and no window gathers in one task.

Null texts are empty; texts shorter than a window lose nothing.  Matches never cross texts.
Repeated rows are repeats of each other.  Null ids are allowed: rows are known by id and
64-bit hash of the text.  Columns named as the new ones are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, mix, raw, replace_columns, saved, small_batches, steps
from .packing import planes, runs, sliced, unplaned

WINDOW, GRAM = 200, 73
#: Grams in a window: a power of two.
WIDTH = WINDOW - GRAM + 1
assert WIDTH & (WIDTH - 1) == 0
#: Windows that are hashed at a time.
PIECE = 1 << 18
#: Text for which there is one bucket, suffixes that a task holds as one batch, and suffixes of one bucket in step 3.
BUCKET_BYTES, HELD, BUCKET_WINDOWS = 12 << 20, 300_000, 400_000
#: Suffixes that arrive in a bucket before they are made a level.
ARRIVED = 50_000
#: Different stretches of one gram that a level tells apart.
MOST = 64
SEEN, EDGE, HOT = 1, 2, 4
LAST = 2**63 - 1
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
POWER = np.cumprod(np.append(np.uint64(1), np.full(PIECE + 2 * WINDOW, 0xD6E8FEB86659FD93, np.uint64)))
DEALT = "bucket int, passed boolean, grams binary, stretches binary, docs binary, counts binary, codes binary, flags binary"
PACKED = "bucket int, docs binary, counts binary, codes binary"
FOUND = "doc long, variant long, codes binary, windows long"
NAMES = lambda schema: [c.split()[0] for c in schema.split(", ")]
#: A batch: gram, stretch, document, variant, code and flags of each suffix.
Batch = tuple[np.ndarray, ...]


def encoded(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The windows that start at ``at`` and the ``count - 1`` places behind it, as one number; the
    lowest bit is for ``EDGE`` findings."""
    return (at.astype(np.uint64) << np.uint64(8)) | ((count.astype(np.uint64) - np.uint64(1)) << np.uint64(1))


def decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, and whether the windows have to be looked up one by one."""
    return (code >> np.uint64(8)).astype(np.int64), ((code >> np.uint64(1)) & np.uint64(127)).astype(np.int64) + 1, (code & np.uint64(1)).astype(bool)


class Hashes:
    """Hashes of stretches of up to ``PIECE`` and two windows of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * POWER[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * POWER[len(POWER) - 1 - start])


def anchored(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, at, count, gram, stretch)`` of the suffixes of texts, piece by piece; every window is in one of them."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for low in range(0, len(data), PIECE):
        part = data[low : low + PIECE + WINDOW - 1]
        n = len(part) - WINDOW + 1
        if n <= 0:
            break
        h = Hashes(part)
        place = np.arange(len(part) - GRAM + 1)
        grams = h.of(place, place + GRAM)
        least = (grams >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
        step = 1
        while step < WIDTH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
        text = np.searchsorted(ends, low + np.arange(n), "right")
        whole = low + np.arange(n) + WINDOW <= ends[text]
        p = np.flatnonzero(whole)
        if not len(p):
            continue
        text, anchor = text[p], anchor[p]
        first = runs(text, anchor)
        count = np.diff(np.append(first, len(p)))
        p, text, anchor = p[first], text[first], anchor[first]
        shape = mix((count.astype(np.uint64) << np.uint64(32)) | (anchor - p).astype(np.uint64))
        yield text, low + p - (ends[text] - np.array([len(t) for t in texts])[text]), count, grams[anchor], mix(h.of(p, p + count - 1 + WINDOW) ^ shape)


def windows(texts: list[bytes], at: list[np.ndarray], count: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, at, hash)`` of all windows that start at ``at`` and the ``count - 1`` places behind."""
    held: list[tuple[int, int, int]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, start, many = (np.array(x, np.int64) for x in zip(*held))
        h = Hashes(np.frombuffer(b"".join([texts[t][s : s + c - 1 + WINDOW] for t, s, c in held]), np.uint8))
        sizes = many - 1 + WINDOW
        base = np.cumsum(sizes) - sizes
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        p = np.repeat(base, many) + within
        return np.repeat(text, many), np.repeat(start, many) + within, h.of(p, p + WINDOW)

    for t, (starts, counts) in enumerate(zip(at, count)):
        for s, c in zip(starts.tolist(), counts.tolist()):
            if held and size + c + WINDOW > PIECE:
                yield flush()
                held, size = [], 0
            held.append((t, s, c))
            size += c - 1 + WINDOW
    if held:
        yield flush()


def joined(*batches: Batch) -> Batch:
    return tuple(np.concatenate(x) for x in zip(*batches))


def picked(batch: Batch, which: np.ndarray) -> Batch:
    return tuple(x[which] for x in batch)


def meet(*batches: Batch) -> tuple[Batch, Batch, np.ndarray]:
    """Merge-scan of sorted or unsorted batches: what is found (documents, variants, codes), the
    sorted suffixes that stay, one for each stretch, the earlier batch's first, and the batch
    that each is from.

    Suffixes of a stretch that occurs twice are found; a stretch that is not the only one of
    its gram is found as ``EDGE``, once.
    """
    gram, stretch, doc, variant, code, flag = joined(*batches)
    source = np.repeat(np.arange(len(batches)), [len(b[0]) for b in batches])
    order = np.lexsort((stretch, gram))  # stable
    gram, stretch, doc, variant, code, flag, source = (x[order] for x in (gram, stretch, doc, variant, code, flag, source))
    if not len(gram):
        return (doc, variant, code), (gram, stretch, doc, variant, code, flag), source
    first = runs(gram, stretch)
    sizes = np.diff(np.append(first, len(gram)))
    flags = np.bitwise_or.reduceat(flag, first)
    twice = (sizes > 1) | (flags & SEEN > 0)
    same = np.repeat(twice, sizes) & (flag & SEEN == 0)
    found = (doc[same], variant[same], code[same])
    gram, stretch, doc, variant, code, source = (x[first] for x in (gram, stretch, doc, variant, code, source))
    flags |= np.where(twice, SEEN, 0).astype(np.uint8)
    of_gram = runs(gram)
    many = np.diff(np.append(of_gram, len(gram)))
    shared = np.repeat((many > 1) | (np.bitwise_or.reduceat(flags, of_gram) & (EDGE | HOT) > 0), many)
    edge = shared & (flags & EDGE == 0)
    found = tuple(np.concatenate(x) for x in zip(found, (doc[edge], variant[edge], code[edge] | np.uint64(1))))
    flags |= np.where(shared, EDGE, 0).astype(np.uint8)
    hot = np.repeat((many > MOST) | (np.bitwise_or.reduceat(flags, of_gram) & HOT > 0), many)
    flags |= np.where(hot, HOT, 0).astype(np.uint8)
    stays = ~hot
    stays[of_gram] = True
    return found, picked((gram, stretch, doc, variant, code, flags), stays), source[stays]


class Family:
    """Sorted levels of geometric sizes."""

    def __init__(self) -> None:
        self.levels: list[Batch] = []

    def add(self, batch: Batch) -> list[Batch]:
        """Scans a new batch against itself and every level; returns what was found."""
        found, batch, _ = meet(batch)
        out = [found]
        for i in range(len(self.levels) - 1, -1, -1):
            found, stays, source = meet(self.levels[i], batch)
            out.append(found)
            self.levels[i], batch = picked(stays, source == 0), picked(stays, source == 1)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            last = self.levels.pop()
            found, merged, _ = meet(self.levels.pop(), last)
            out.append(found)
            self.levels.append(merged)
        return out


def _documents(bucket: np.ndarray, doc: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Buckets used, ends of their records, ends of their documents, and for records sorted by bucket and document the documents and their numbers of records."""
    first = runs(bucket, doc, variant)
    used = np.unique(bucket)
    ends, doc_ends = np.searchsorted(bucket, used, "right"), np.searchsorted(bucket[first], used, "right")
    counts = np.diff(first, append=len(doc)).astype("<u4")
    return used, ends, doc_ends, sliced(np.column_stack([doc[first], variant[first]]).view("V16").ravel(), doc_ends), planes(counts, doc_ends, 4)


def _send(batch: Batch, buckets: int) -> pa.RecordBatch:
    gram, stretch, doc, variant, code, flag = batch
    bucket = (gram % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((code, variant, doc, bucket))
    bucket, gram, stretch, doc, variant, code, flag = (x[order] for x in (bucket, *batch))
    used, ends, _, docs, counts = _documents(bucket, doc, variant)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.zeros(len(used), bool)), planes(gram, ends, 8), planes(stretch, ends, 8), docs, counts, planes(code, ends, 5), sliced(flag, ends)], names=NAMES(DEALT))


def _pass_on(found: Batch, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Findings that need no bucket, in small rows over all buckets."""
    doc, variant, code = found
    size, none = max(256, -(-len(doc) // buckets)), pa.array([b""], pa.binary())
    for i, low in enumerate(range(0, len(doc), size)):
        part = slice(low, low + size)
        ids = pa.array([np.column_stack([doc[part], variant[part]]).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([(turn + i) % buckets], pa.int32()), pa.array([True]), none, none, ids, none, pa.array([code[part].tobytes()], pa.binary()), none], names=NAMES(DEALT))


def _back(found: Batch, buckets: int) -> Iterator[pa.RecordBatch]:
    """Findings on their way to their documents: one row for each bucket of documents."""
    doc, variant, code = found
    if not len(doc):
        return
    bucket = (mix(doc.astype(np.uint64) ^ mix(variant.astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((code, variant, doc, bucket))
    bucket, doc, variant, code = bucket[order], doc[order], variant[order], code[order]
    used, ends, _, docs, counts = _documents(bucket, doc, variant)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), docs, counts, planes(code, ends, 5)], names=NAMES(PACKED))


def _unpacked(docs: bytes, counts: bytes, codes: bytes) -> Batch:
    ids, many = np.frombuffer(docs, "<i8").reshape(-1, 2), unplaned(counts, 4, "<u4")
    return np.repeat(ids[:, 0], many), np.repeat(ids[:, 1], many), unplaned(codes, 5, "<u8")


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All findings of a document in one row; a bucket's rows come together."""
    held: list[Batch] = []
    bucket = None

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            doc, variant, code = joined(*held)
            held.clear()
            order = np.lexsort((code, variant, doc))
            doc, variant, code = doc[order], variant[order], code[order]
            first = runs(doc, variant)
            _, count, edge = decoded(code)
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(variant[first]), sliced(code, np.append(first[1:], len(doc))), pa.array(np.add.reduceat(count * edge, first))], names=NAMES(FOUND))
            give_back()

    for batch in batches:
        for b, *packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b != bucket:
                yield from close()
                bucket = b
            held.append(_unpacked(*packed))
    yield from close()


def indexed(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[Batch]], buckets: int) -> DataFrame:
    """Findings by document of the suffixes that ``make`` takes from batches of rows."""

    def outgoing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Batch] = []
        n, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, turn
            found, stays, _ = meet(*held)
            held.clear()
            n = 0
            yield from _pass_on(found, buckets, turn)
            turn += int(stays[0][0] % np.uint64(buckets)) + 1
            yield _send(stays, buckets)

        for part in make(batches):
            if len(part[0]):
                held.append(part)
                n += len(part[0])
            if n >= HELD:
                yield from flush()
        if n:
            yield from flush()
        give_back()

    def incoming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, arrived, done = Family(), [], []
        bucket = None

        def add() -> None:
            if arrived:
                done.extend(family.add(joined(*arrived)))
                arrived.clear()

        def back(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in done) > least:
                yield from _back(joined(*done), buckets)
                done.clear()

        for batch in batches:
            for b, passed, gram, stretch, docs, counts, codes, flags in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if passed:
                    ids = np.frombuffer(docs, "<i8").reshape(-1, 2)
                    done.append((ids[:, 0], ids[:, 1], np.frombuffer(codes, "<u8")))
                    continue
                if b != bucket:
                    add()
                    yield from back(HELD // 4)
                    family, bucket = Family(), b
                    give_back()
                arrived.append((unplaned(gram, 8, "<u8"), unplaned(stretch, 8, "<u8"), *_unpacked(docs, counts, codes), np.frombuffer(flags, np.uint8)))
                if sum(len(x[0]) for x in arrived) >= ARRIVED:
                    add()
        add()
        yield from back(0)

    by_bucket = lambda x: x.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return by_bucket(by_bucket(rows.mapInArrow(outgoing, DEALT)).mapInArrow(incoming, PACKED)).mapInArrow(_by_document, FOUND)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for batch in steps(batches, "text"):
        doc, variant = batch.column("doc").to_numpy(), batch.column("variant").to_numpy()
        for text, at, count, gram, stretch in anchored([t or b"" for t in raw(batch.column("text"))]):
            yield gram, stretch, doc[text], variant[text], encoded(at, count), np.zeros(len(text), np.uint8)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for batch in steps(batches, "text"):
        doc, variant = batch.column("doc").to_numpy(), batch.column("variant").to_numpy()
        at, count = [], []
        for codes in batch.column("codes").to_pylist():
            a, c, edge = decoded(np.frombuffer(codes, "<u8"))
            at.append(a[edge])
            count.append(c[edge])
        for text, place, window in windows([t or b"" for t in raw(batch.column("text"))], at, count):
            yield window, np.zeros(len(window), np.uint64), doc[text], variant[text], encoded(place, np.ones(len(place), np.int64)), np.zeros(len(place), np.uint8)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
NEW = {"kept": T.BinaryType(), "n_bytes": T.LongType(), "spans": T.ArrayType(SPAN)}


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``kept`` (the bytes that stay; a cut may fall within a character), ``n_bytes`` and
    ``spans``, the removed runs of bytes as start and end."""
    spark = df.sparkSession
    small_batches(spark)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    inner = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(inner[c]) for c in df.columns]).withColumns({"doc": F.coalesce(F.col(inner[doc_id]).cast("long"), F.lit(LAST)), "variant": F.xxhash64(inner[text])})
    texts = lambda x: x.withColumnRenamed(inner[text], "text")

    found = saved(indexed(texts(rows).select("doc", "variant", "text"), _suffixes, buckets))
    edges = found.agg(F.sum("windows")).first()[0] or 0
    # With all columns, so that both joins read one shuffle of the texts.
    near = texts(rows.join(found.where("windows > 0"), ["doc", "variant"]))
    single = indexed(near, _windows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges // BUCKET_WINDOWS)))

    out = T.StructType([f for f in rows.schema.fields if f.name not in ("doc", "variant")] + [T.StructField(k, t) for k, t in NEW.items()])
    text_name = inner[text]
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_name):
            kept, sizes, starts, ends, many = [], [], [], [], [0]
            for t, *codes in zip(raw(batch.column(text_name)), batch.column("whole").to_pylist(), batch.column("single").to_pylist()):
                t = t or b""
                at, count, edge = decoded(np.concatenate([np.frombuffer(c or b"", "<u8") for c in codes]))
                at, end = at[~edge], (at + count - 1 + WINDOW)[~edge]
                if len(at):
                    order = np.argsort(at)
                    at, end = at[order], np.maximum.accumulate(end[order])
                    first = np.flatnonzero(np.append(True, at[1:] > end[:-1]))
                    at, end = at[first], np.append(end[first[1:] - 1], end[-1])
                    t, whole = b"".join([t[a:b] for a, b in zip([0, *end.tolist()], [*at.tolist(), len(t)])]), len(t)
                else:
                    whole = len(t)
                kept.append(t)
                sizes.append(whole)
                starts.append(at)
                ends.append(end)
                many.append(many[-1] + len(at))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], fields=list(pair))
            yield replace_columns(batch, ["doc", "variant", "whole", "single"], kept=pa.array(kept, pa.binary()), n_bytes=pa.array(sizes, pa.int64()), spans=pa.ListArray.from_arrays(pa.array(many, pa.int32()), spans))

    key = ["doc", "variant"]
    both = rows.join(found.select(*key, F.col("codes").alias("whole")), key, "left").join(single.select(*key, F.col("codes").alias("single")), key, "left")
    done = both.select(*[f.name for f in rows.schema.fields], "whole", "single").mapInArrow(cut, out)
    return done.select(*[F.col(inner[c]).alias(c) for c in df.columns if c not in NEW], *NEW)
