"""Token counts from flat token files, by a scan for end-of-document identifiers.

A token file is little-endian 16- or 32-bit ids, one document behind the other,
each closed by one identifier that no text yields; nothing else says where a
document ends.  Files are read in blocks, each by a task of its own.  A block
finds its separators with one vectorised comparison and reports the lengths
between them and what is left behind the last one.  A prefix scan over the
blocks of a file carries open lengths and the number of documents forward.

``write_tokens`` makes such files below a folder that all executors share.
Null and empty texts are documents of no tokens.  Tokens behind a file's last
separator are reported as a document that is not closed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import encoder
from .common import saved, small_batches, steps

BLOCK_TOKENS = 1 << 21
BLOCKS = "file string, block long, n_closed long, tail long, lengths binary"


def write_tokens(df: DataFrame, folder: str, ranks_path: str, end: int, doc_id: str = "doc_id", text: str = "text", dtype: str = "<u2") -> DataFrame:
    """Writes one file for each task and returns, as a table in the shared folder, the
    order of documents: ``(file, ordinal, doc_id)``.

    A repeated task writes a file of another name, and only the rows of the one that
    counts get into the table; ``scan`` ignores files that the table does not name.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("doc_id", df.schema[doc_id].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, n, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, None
        close = np.array([end], dtype)
        for batch in steps(batches, text):
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            for ids in coder.encode([t or "" for t in batch.column(text).to_pylist()]):
                out.write(np.frombuffer(ids, "<u4").astype(dtype).tobytes())
                out.write(close.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column(doc_id)], names=["file", "ordinal", "doc_id"])
            n += batch.num_rows
        if out:
            out.close()

    return saved(df.select(doc_id, text).mapInArrow(run, schema))


def scan(spark: SparkSession, folder: str, end: int, files: DataFrame | None = None, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, ordinal, n_tokens, closed)`` of every document in the files of a folder;
    ``files`` (column ``file``) restricts it to these."""
    width = np.dtype(dtype).itemsize
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    if files is not None:
        found = found.join(files.select("file").distinct(), "file", "left_semi")
    found = found.where(F.col("length") >= width)
    step = block_tokens * width
    blocks = found.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))
    blocks = blocks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                with fs.open_input_file(f"{base}/{file}") as f:
                    data = f.read_at(min(step, f.size() - block * step), block * step)
                ids = np.frombuffer(data, dtype, len(data) // width)
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(ids) - (at[-1] + 1 if len(at) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([len(at)]), pa.array([int(tail)]), pa.array([lengths.astype("<i8").tobytes()], pa.binary())], names=["file", "block", "n_closed", "tail", "lengths"])

    parts = saved(blocks.mapInArrow(read, BLOCKS))
    # The scan: what is open before a block, and how many documents its file has closed by then.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("file", "block", "n_closed", "tail").withColumns({"ordinal": F.coalesce(F.sum("n_closed").over(before), F.lit(0)), "run": F.coalesce(F.sum("tail").over(before), F.lit(0))})
    mark = F.last(F.when(F.col("n_closed") > 0, F.col("run")), ignorenulls=True).over(before)
    last = F.max("block").over(Window.partitionBy("file"))
    sums = sums.withColumns({"carry": F.col("run") - F.coalesce(mark, F.lit(0)), "is_last": F.col("block") == last})
    joined = parts.select("file", "block", "lengths").join(sums, ["file", "block"]).select("file", "lengths", "n_closed", "tail", "ordinal", "carry", "is_last")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data, n_closed, tail, ordinal, carry, is_last in zip(*(batch.column(i).to_pylist() for i in range(7))):
                lengths = np.frombuffer(data, "<i8").copy()
                lengths[:1] += carry
                closed = np.ones(n_closed, bool)
                rest = tail + (0 if n_closed else carry)
                if is_last and rest:
                    lengths, closed = np.append(lengths, rest), np.append(closed, False)
                if len(lengths):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(lengths)), pa.array(np.arange(ordinal, ordinal + len(lengths))), pa.array(lengths), pa.array(closed)], names=["file", "ordinal", "n_tokens", "closed"])

    return joined.mapInArrow(stitch, "file string, ordinal long, n_tokens long, closed boolean")
