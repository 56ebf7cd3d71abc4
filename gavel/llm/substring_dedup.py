"""Removal of passages that also start in an earlier document, by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  Only shorter windows, of ``ANCHOR``
words, at word positions whose remainder modulo ``PERIOD`` is in ``COVER`` are
hashed first.  Any two positions have a common shift below the period that
takes both to cover positions, so two equal windows always share an aligned
anchor.  Then:

1. Anchor hashes are dealt into buckets; those of two or more documents stay.
2. Around these anchors whole windows are hashed and dealt again; the least
   document of each window keeps it.
3. Every document drops the words that its other windows cover.

Hashes travel as packed arrays, one row for each task and bucket; a task first
merges equal hashes of its own, so a passage that is everywhere reaches a
bucket once for each task.  Texts are shuffled once.

Null texts have no words, and texts of fewer words than a window lose none.
Rows with one id do not remove each other's words; null ids count as one id, the
greatest.  Findings go back by id and 64-bit hash of the text, so that neither
many rows of one id nor null ids meet in one task.  Repeated rows each get their own
row.  Windows are known by 64-bit hashes of their words (chance of a false match for
each window: windows / 2^64).  Columns named as the new ones are replaced.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, mix, raw, replace_columns, small_batches, steps
from .packing import planes, sliced, unplaned
from .word_hashes import places, run_hashes, word_hashes

WINDOW, ANCHOR, PERIOD, COVER = 13, 7, 7, (0, 1, 3)
assert PERIOD - 1 + ANCHOR <= WINDOW
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
#: Text for which there is one bucket, and hashes that a task holds before it sends them.
BUCKET_BYTES, HELD = 12 << 20, 400_000
DEALT = "bucket int, passed boolean, hashes binary, docs binary, counts binary, ats binary, marks binary"
FOUND = "doc long, variant long, ats binary"
PACKED = "bucket int, docs binary, counts binary, ats binary"
LAST = 2**63 - 1


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of equal runs, and the run of every element."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _send(bucket: np.ndarray, width: int, h: np.ndarray, doc: np.ndarray, variant: np.ndarray, at: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket; within it the records are in document order, and a
    document is written once with its number of records."""
    order = np.lexsort((at, variant, doc, bucket))
    bucket, h, doc, variant, at, mark = (x[order] for x in (bucket, h, doc, variant, at, mark))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    used = np.unique(bucket)
    ends, doc_ends = np.searchsorted(bucket, used, "right"), np.searchsorted(bucket[first], used, "right")
    counts = np.diff(first, append=len(doc)).astype("<u4")
    ids = np.column_stack([doc[first], variant[first]])
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(np.zeros(len(used), bool)), planes(h.astype("<u8"), ends, width), sliced(ids.view("V16").ravel(), doc_ends), planes(counts, doc_ends, 4), planes(at.astype("<u4"), ends, 4), sliced(mark.astype(np.uint8), ends)],
        names=[c.split()[0] for c in DEALT.split(", ")],
    )


def _pass_on(doc: np.ndarray, variant: np.ndarray, at: np.ndarray, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Findings that need no bucket, in small rows over all buckets."""
    size = max(256, -(-len(doc) // buckets))
    for i, low in enumerate(range(0, len(doc), size)):
        part = slice(low, low + size)
        d = np.column_stack([doc[part], variant[part]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([(turn + i) % buckets], pa.int32()), pa.array([True]), pa.array([b""], pa.binary()), pa.array([d.tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([at[part].astype(np.uint32).tobytes()], pa.binary()), pa.array([b""], pa.binary())],
            names=[c.split()[0] for c in DEALT.split(", ")],
        )


def _runs(doc: np.ndarray, variant: np.ndarray) -> np.ndarray:
    """Starts of runs of one document."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])
    return np.flatnonzero(new)


def _back(doc: np.ndarray, variant: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Findings on their way back to their documents: one row for each bucket of documents."""
    if not len(doc):
        return
    bucket = (mix(doc.astype(np.uint64) ^ mix(variant.astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((at, variant, doc, bucket))
    bucket, doc, variant, at = bucket[order], doc[order], variant[order], at[order].astype("<u4")
    first = _runs(doc, variant)
    used = np.unique(bucket)
    ends, doc_ends = np.searchsorted(bucket, used, "right"), np.searchsorted(bucket[first], used, "right")
    counts = np.diff(first, append=len(doc)).astype("<u4")
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), sliced(np.column_stack([doc[first], variant[first]]).view("V16").ravel(), doc_ends), planes(counts, doc_ends, 4), planes(at, ends, 4)], names=["bucket", "docs", "counts", "ats"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All findings of a document in one row; a bucket's rows come together."""
    held: list[tuple[np.ndarray, ...]] = []
    bucket = None

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            doc, variant, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((variant, doc))
            doc, variant, at = doc[order], variant[order], at[order]
            first = _runs(doc, variant)
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(variant[first]), sliced(at, np.append(first[1:], len(doc)))], names=["doc", "variant", "ats"])
            give_back()

    for batch in batches:
        for b, d, c, a in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b != bucket:
                yield from close()
                bucket = b
            ids, counts = np.frombuffer(d, "<i8").reshape(-1, 2), unplaned(c, 4, "<u4")
            held.append((np.repeat(ids[:, 0], counts), np.repeat(ids[:, 1], counts), unplaned(a, 4, "<u4")))
    yield from close()


def _deal(rows: DataFrame, make, settle, buckets: int, width: int = 8) -> DataFrame:
    """``make`` turns batches into arrays (hash, doc, variant, at); ``settle`` splits the
    sorted records of equal hashes into those found already, those to send, and marks.
    Within a bucket ``width`` bytes of a hash are told apart."""

    def outgoing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, turn
            h, doc, variant, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            n = 0
            order = np.lexsort((doc, h))
            h, doc, variant, at = h[order], doc[order], variant[order], at[order]
            found, send, mark = settle(h, doc, None)
            yield from _pass_on(doc[found], variant[found], at[found], buckets, turn)
            turn += int(h[0] % np.uint64(buckets)) + 1
            yield _send((h[send] % np.uint64(buckets)).astype(np.int32), width, h[send] // np.uint64(buckets), doc[send], variant[send], at[send], mark[send])

        for part in make(batches):
            if len(part[0]):
                held.append(part)
                n += len(part[0])
            if n >= HELD:
                yield from flush()
        if n:
            yield from flush()

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        done: list[tuple[np.ndarray, ...]] = []  # findings to go back, together
        bucket = None

        def back(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in done) > least:
                yield from _back(*(np.concatenate(x) for x in zip(*done)), buckets)
                done.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                h, doc, variant, at, mark = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((doc, h))
                h, doc, variant, at, mark = h[order], doc[order], variant[order], at[order], mark[order]
                found, _, _ = settle(h, doc, mark)
                found &= mark == 0
                done.append((doc[found], variant[found], at[found]))
                held.clear()
                give_back()
            yield from back(HELD // 4)

        for batch in batches:
            for b, passed, h, d, c, a, m in zip(*(batch.column(i).to_pylist() for i in range(7))):
                ids = np.frombuffer(d, "<i8").reshape(-1, 2)
                if passed:
                    done.append((ids[:, 0], ids[:, 1], np.frombuffer(a, "<u4")))
                    continue
                if b != bucket:
                    yield from close()
                    bucket = b
                counts = unplaned(c, 4, "<u4")
                held.append((unplaned(h, width, "<u8"), np.repeat(ids[:, 0], counts), np.repeat(ids[:, 1], counts), unplaned(a, 4, "<u4"), np.frombuffer(m, np.uint8)))
        yield from close()
        yield from back(0)

    by_bucket = lambda x: x.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return by_bucket(by_bucket(rows.mapInArrow(outgoing, DEALT)).mapInArrow(settled, PACKED)).mapInArrow(_by_document, FOUND)


def _shared(h: np.ndarray, doc: np.ndarray, mark: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: those in several documents are found; one of them is sent on, marked."""
    starts, group = _groups(h)
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.uint8)
    ends = np.append(starts[1:], len(h)) - 1
    several = doc[starts] != doc[ends]
    if mark is not None:
        several |= np.maximum.reduceat(mark, starts) > 0
    found = several[group]
    first = np.zeros(len(h), bool)
    first[starts] = True
    return found, ~found | first, found.astype(np.uint8)


def _later(h: np.ndarray, doc: np.ndarray, mark: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows: those of other documents than the least are found; the least one's are sent on."""
    starts, group = _groups(h)
    found = doc != doc[starts][group] if len(h) else np.zeros(0, bool)
    return found, ~found, np.zeros(len(h), np.uint8)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    cover = np.isin(np.arange(PERIOD), COVER)
    for batch in steps(batches, "text"):
        words, counts = word_hashes([t or b"" for t in raw(batch.column("text"))])
        h = run_hashes(words, ANCHOR)
        text, at = places(counts)
        text, at = text[: len(h)], at[: len(h)]
        use = cover[at % PERIOD] & (at + ANCHOR <= counts[text]) & (counts[text] >= WINDOW)
        row = text[use]
        yield h[use], batch.column("doc").to_numpy()[row], batch.column("variant").to_numpy()[row], at[use].astype(np.uint32)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in steps(batches, "text"):
        words, counts = word_hashes([t or b"" for t in raw(batch.column("text"))])
        h = run_hashes(words, WINDOW)
        base = np.cumsum(counts) - counts
        wanted = np.zeros(len(words) + 1, np.int32)
        for i, found in enumerate(batch.column("found").to_pylist()):
            at = np.frombuffer(found, "<u4").astype(np.int64)
            at = at[at < counts[i]]
            np.add.at(wanted, base[i] + np.maximum(0, at - (WINDOW - ANCHOR)), 1)
            np.add.at(wanted, base[i] + at + 1, -1)
        text, at = places(counts)
        text, at = text[: len(h)], at[: len(h)]
        use = (np.cumsum(wanted)[: len(h)] > 0) & (at + WINDOW <= counts[text])
        row = text[use]
        yield h[use], batch.column("doc").to_numpy()[row], batch.column("variant").to_numpy()[row], at[use].astype(np.uint32)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``kept_text`` (the words that stay, joined by one space), ``n_words`` and ``n_removed``."""
    spark = df.sparkSession
    small_batches(spark)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    inner = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(c).alias(inner[c]) for c in df.columns]).withColumns({"doc": F.coalesce(F.col(inner[doc_id]).cast("long"), F.lit(LAST)), "variant": F.xxhash64(inner[text])})
    texts = lambda x: x.withColumnRenamed(inner[text], "text")

    shared = _deal(texts(rows).select("doc", "variant", "text"), _anchors, _shared, buckets, width=6)  # whole windows are compared next
    # With all columns, so that both joins read one shuffle of the texts.
    near = texts(rows.join(shared.withColumnRenamed("ats", "found"), ["doc", "variant"]))
    later = _deal(near, _windows, _later, buckets)

    new = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    out = T.StructType([f for f in rows.schema.fields if f.name not in ("doc", "variant")] + new)
    text_name = inner[text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_name):
            kept, counts, removed = [], [], []
            for t, found in zip(raw(batch.column(text_name)), batch.column("found").to_pylist()):
                words = (t or b"").split()
                counts.append(len(words))
                if found:
                    at = np.frombuffer(found, "<u4").astype(np.int64)
                    edge = np.zeros(len(words) + WINDOW + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    stays = np.cumsum(edge)[: len(words)] == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield replace_columns(batch, ["doc", "variant", "found"], kept_text=pa.array(kept, pa.binary()).cast(pa.string()), n_words=pa.array(counts, pa.int64()), n_removed=pa.array(removed, pa.int64()))

    done = rows.join(later.withColumnRenamed("ats", "found"), ["doc", "variant"], "left").select(*[f.name for f in rows.schema.fields], "found").mapInArrow(cut, out)
    keep = [F.col(inner[c]).alias(c) for c in df.columns if c not in ("kept_text", "n_words", "n_removed")]
    return done.select(*keep, "kept_text", "n_words", "n_removed")
