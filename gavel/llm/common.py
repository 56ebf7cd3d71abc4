"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds unpacked at a time.
STEP_BYTES = 1 << 20
#: Bytes of a batch on its way to Python.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where the session names none, a temporary folder is made and set for the
    session, on one machine only; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gavel-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send texts to Python ``BATCH_BYTES`` at a time instead of by its default of 64 MB,
    so that a worker's memory does not follow the lengths of texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def hidden(df: DataFrame, text: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns under names that clash with nothing, the text as ``text``; and how
    to select the old columns again."""
    inner = {c: "text" if c == text else f"in_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(inner[c]) for c in df.columns]), [F.col(inner[c]).alias(c) for c in df.columns]


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``: the folds of the learned operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def give_back() -> None:
    """Returns what Python and Arrow have freed to the system: workers stay between tasks, and
    share a machine's memory with Spark."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``text`` or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rows_to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def replace_columns(batch: pa.RecordBatch, drop: list[str], **columns) -> pa.RecordBatch:
    """``batch`` without ``drop`` and with the new columns behind the others."""
    keep = [i for i, n in enumerate(batch.schema.names) if n not in drop and n not in columns]
    names = [batch.schema.names[i] for i in keep] + list(columns)
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(columns.values()), names=names)
