"""The nearest chunks of queries, by matrix products of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that go to the tasks at a time; more queries take more passes over the chunks.
QUERY_BYTES = 32 << 20
#: Chunks that are multiplied at a time, times queries.
CELLS = 1 << 22
#: What two ways to add up a cosine may differ by.
SLACK = 1e-9


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, added up from first to last, so that equal vectors have equal cosines wherever they stand."""
    add = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    return add(a, b) / (np.sqrt(add(a, a)) * np.sqrt(add(b, b)))


class _Queries:
    """Queries of one pass: vectors by scope, and the place of each one's date among all dates."""

    def __init__(self, rows: pa.Table, scope: list[str], dims: int) -> None:
        self.ids = rows.column("query_id").combine_chunks()
        self.vectors = rows.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        dates = rows.column("_date").combine_chunks()
        known = np.flatnonzero(~np.asarray(dates.is_null()))
        self.dates, places = np.unique(dates.take(pa.array(known)).to_numpy(zero_copy_only=False), return_inverse=True)
        self.date = np.full(len(dates), -1)
        self.date[known] = places
        self.scopes: dict[tuple, np.ndarray] = {}
        for i, s in enumerate(zip(*(rows.column(c).to_pylist() for c in scope))):
            if None not in s:
                self.scopes.setdefault(s, []).append(i)
        self.scopes = {s: np.array(i) for s, i in self.scopes.items()}

    def places(self, moments: pa.Array, side: str, null: int) -> np.ndarray:
        """How many dates are before each moment (``left``)."""
        out = np.full(len(moments), null)
        known = np.flatnonzero(~np.asarray(moments.is_null()))
        if len(known) and len(self.dates):
            out[known] = np.searchsorted(self.dates, moments.take(pa.array(known)).to_numpy(zero_copy_only=False), side)
        elif len(known):
            out[known] = 0
        return out


class _Best:
    """The k best chunks of each query so far."""

    def __init__(self, k: int, kind: pa.DataType) -> None:
        self.k, self.size, self.kept = k, 0, pa.table({"q": pa.array([], pa.int64()), "chunk_id": pa.array([], kind), "score": pa.array([], pa.float64())})
        self.parts: list[pa.Table] = []

    def add(self, q: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.parts.append(pa.table({"q": pa.array(q, pa.int64()), "chunk_id": ids, "score": pa.array(score)}))
        self.size += len(q)
        if self.size > 1 << 16:
            self.cut()

    def cut(self) -> pa.Table:
        rows = pa.concat_tables([self.kept, *self.parts]).sort_by([("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        q = rows.column("q").to_numpy()
        first = np.searchsorted(q, q)
        self.kept, self.parts, self.size = rows.filter(pa.array(np.arange(len(q)) - first < self.k)), [], 0
        return self.kept


def nearest(queries: DataFrame, chunks: DataFrame, k: int = 5, scope: tuple[str, ...] = ("domain",), vector: str = "embedding") -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the ``k`` nearest chunks of each query by cosine distance, ties by
    chunk id, among those of its scope (all columns of ``scope`` equal, none null) that are valid at
    its ``evaluation_date`` (``valid_from`` null or not later, ``valid_to`` null or later) and, where chunks have
    a ``state``, APPROVED.  The score is the cosine; chunks rank by it unrounded.

    All chunks are compared.  A task multiplies blocks of chunks with all queries of their scope and
    keeps each query's best k, so what is shuffled is k rows for each query and task.  Vectors
    with null or non-finite entries, of another length than the queries' (the commonest
    one), or of length 0 are left out, on both sides; see ``check_vectors``.
    """
    names = list(scope)
    finite = lambda v: ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def usable(df: DataFrame) -> DataFrame:
        df = df.withColumn("_v", F.col(vector).cast("array<double>")).where(F.col("_v").isNotNull())
        return df.where(finite("_v")).where(F.exists("_v", lambda x: x != 0))

    q = usable(queries).select("query_id", *names, F.col("evaluation_date").alias("_date"), "_v")
    shape = q.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = T.StructType([T.StructField("_q", T.LongType()), T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    empty = queries.sparkSession.createDataFrame([], T.StructType([queries.schema["query_id"], *out.fields[1:], T.StructField("rank", T.IntegerType())]))
    if shape is None:
        return empty
    dims, n = shape
    approved = chunks.where("state = 'APPROVED'") if "state" in chunks.columns else chunks
    c = usable(approved).where(F.size("_v") == dims).select("chunk_id", *names, "valid_from", "valid_to", "_v")
    passes = -(-n * dims * 8 // QUERY_BYTES)
    made = []
    for turn in range(passes):
        rows = q.where(F.size("_v") == dims).where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn).toArrow()
        if not rows.num_rows:
            continue
        asked = _Queries(rows, names, dims)
        sent = queries.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, best = sent.value, None
            for batch in batches:
                ids = batch.column("chunk_id")
                best = best or _Best(k, ids.type)
                flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                since, until = asked.places(batch.column("valid_from"), "left", -1), asked.places(batch.column("valid_to"), "left", len(asked.dates) + 1)
                always = np.asarray(batch.column("valid_from").is_null()), np.asarray(batch.column("valid_to").is_null())
                at: dict[tuple, list[int]] = {}
                for i, s in enumerate(zip(*(batch.column(x).to_pylist() for x in names))):
                    at.setdefault(s, []).append(i)
                for s, places in at.items():
                    if s not in asked.scopes:
                        continue
                    which = asked.scopes[s]
                    step = max(1, CELLS // len(which))
                    for low in range(0, len(places), step):
                        p = np.array(places[low : low + step])
                        v = flat[p]
                        score = (v @ asked.vectors[which].T) / np.outer(np.sqrt((v**2).sum(axis=1)), asked.norms[which])
                        date = asked.date[which][None, :]
                        fits = ((since[p][:, None] <= date) | always[0][p][:, None]) & ((date < until[p][:, None]) | always[1][p][:, None])
                        fits &= (date >= 0) | (always[0] & always[1])[p][:, None]
                        score[~fits] = -np.inf
                        top = min(k, len(p))
                        worst = np.partition(score, len(p) - top, axis=0)[len(p) - top]
                        i, j = np.nonzero((score >= worst - SLACK) & fits)
                        best.add(which[j], ids.take(pa.array(p[i])), _cosine(v[i], asked.vectors[which[j]]))
            if best:
                kept = best.cut().combine_chunks()
                yield from kept.rename_columns(["_q", "chunk_id", "score"]).to_batches()

        numbered = queries.sparkSession.createDataFrame(pa.table({"_q": pa.array(range(rows.num_rows), pa.int64()), "query_id": asked.ids}))
        made.append(c.mapInArrow(run, out).join(numbered, "_q").select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), "chunk_id", "score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return reduce(DataFrame.unionByName, made).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) if made else empty
