"""Near-duplicate documents: a Jaccard join on word shingles, filtered under several token orders.

A document's set holds its distinct runs of ``SHINGLE`` words (A-Z lower-cased);
with fewer words the whole sequence is the one member.  Two sets are linked when
100 times their intersection is at least 80 times their union.  A member is
known by a 64-bit hash of its words.  Prefixes under three global orders filter:

1. By hash.  The first ``reach(n)`` members of every set are dealt by member, and
   counted.  A document that is linked to another shares ``extra(n)`` members
   of its prefix at least; those with fewer shared ones are done.
2. By rarity.  The members of all remaining documents are counted exactly.  Linked
   sets share one of their first n - ceil(0.8 n) + 1 members, rarest first,
   at positions that leave room for the overlap; this makes the candidates.
3. By another hash.  Both hash prefixes of a candidate pair must meet in as many
   members as a link needs; only then the sets themselves are joined and compared.

Only components are wanted, so not all candidates are verified: first each
document with one centre of its candidates, and the links are joined into
components; then all candidates between different components, in blocks of
``BLOCK`` by ``BLOCK`` documents.  A pair inside a component needs no check.

Members in cells that hold more than ``HOT_SHARE`` of all documents are never
dealt or counted by document; they count as shared and come last by rarity.

A null text or one without words has an empty set and no links.  A row is known
by a 64-bit hash of its id and text (chance of any two alike: N^2 / 2^65); rows of
one id are linked; equal sets by two further 64-bit sums.  A component's id is its least id that is
not null.  A document joins a component by its links alone, whatever its id.  An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix, raw, saved, small_batches, steps
from .components import components
from .packing import planes, runs, sliced, unplaned
from .word_hashes import places, run_hashes, word_hashes

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST, WHOLE = 80, 100
#: Cells of the table of counts, in chunks; share of all documents, and least number, above which a cell is hot.
CELLS, CHUNKS = 1 << 18, 64
HOT_SHARE, HOT_LEAST = 1 / 128, 1000
#: Bytes of a bucket, members that a task holds before it sends them.
BUCKET_BYTES, HELD = 16 << 20, 300_000
#: Bytes of a member within its bucket and of a row's key, where a false match only keeps a document.
SHORT = 5
#: Row keys that are broadcast to fetch texts or sets; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Documents of a block of candidates.
BLOCK = 256
OTHER = 0x2545F4914F6CDD1D
DEALT = "bucket int, kind int, tokens binary, nodes binary, counts binary"
TALLY = "kind int, node long, doc long, n long, same long, shared long"
SETS = "node long, n long, key_a long, key_b long, first binary, second binary, tokens binary"
RANKED = "bucket int, kind int, tokens binary, nodes binary, counts binary, ranks binary"
POSTINGS = "h long, node long, n int, at int"
#: Width of a rank; hot members rank from here on.
RANK_BYTES, HOT = 5, 1 << 32


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def needed(a, b):
    """Least overlap of two sets of these sizes that links them."""
    return -(-LEAST * (a + b) // (WHOLE + LEAST))


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-LEAST * n // WHOLE) + 1


def extra(n: np.ndarray) -> np.ndarray:
    """Members of a hash prefix that a linked document shares at least."""
    return np.where(n < 100, 1, n // 10)


def reach(n: np.ndarray) -> np.ndarray:
    """Size of a hash prefix."""
    return np.minimum(n, prefix_size(n) - 1 + extra(n))


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members that the hash prefixes of two linked sets of these sizes share at least."""
    t = needed(a, b)
    return np.minimum(reach(a) - a, reach(b) - b) + t


def node_key(doc_id: Column, text: Column) -> Column:
    """What a row is known by."""
    return F.xxhash64(doc_id.cast("long"), text)


def sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Members of all texts' sets (text by text, ascending, distinct), and the texts' indices."""
    words, counts = word_hashes(texts, lower=True)
    h = run_hashes(words, SHINGLE)
    if len(texts) == 1 and counts[0] >= SHINGLE:
        h = np.unique(h)
        return h, np.zeros(len(h), np.int64)
    text, at = places(counts)
    full = at[: len(h)] + SHINGLE <= counts[text[: len(h)]]
    h, owner = h[full], text[: len(h)][full]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        base = np.cumsum(counts) - counts
        whole = np.array([run_hashes(words[base[i] : base[i] + counts[i]], int(counts[i]))[0] for i in short], np.uint64)
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = runs(owner, h)
    return h[first], owner[first]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CELLS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, docs = np.zeros(CELLS, np.int64), 0
    for batch in steps(batches, "text"):
        h, _ = sets([t or b"" for t in raw(batch.column("text"))])
        table += np.bincount(_cell(h), minlength=CELLS)
        docs += batch.num_rows
    if docs:
        parts = list(table.reshape(CHUNKS, -1).astype("<u8")) + [np.array([docs], "<u8")]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS + 1), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            totals[chunk] = totals.get(chunk, 0) + np.frombuffer(counts, "<u8")
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["chunk", "counts"])


def hot_cells(docs: DataFrame) -> np.ndarray:
    """For each cell of the table 0, or the power of two of its count where it is hot."""
    kind = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(_count, kind).repartition(CHUNKS, "chunk").mapInArrow(_sum, kind).collect()  # CELLS numbers
    table, total = np.zeros((CHUNKS, CELLS // CHUNKS), np.uint64), 0
    for row in rows:
        if row["chunk"] == CHUNKS:
            total = int(np.frombuffer(row["counts"], "<u8")[0])
        else:
            table[row["chunk"]] = np.frombuffer(row["counts"], "<u8")
    table = table.ravel()
    return np.where(table > max(HOT_LEAST, total * HOT_SHARE), np.log2(np.maximum(1, table)), 0).astype(np.uint8)


def _deal(kind: int, bucket: np.ndarray, h: np.ndarray, node: np.ndarray, width: int, node_width: int) -> pa.RecordBatch:
    """One row for each bucket; a document is written once with its number of members there."""
    order = np.lexsort((node, bucket))
    bucket, h, node = bucket[order], h[order], node[order]
    first = runs(bucket, node)
    used = np.unique(bucket)
    ends, node_ends = np.searchsorted(bucket, used, "right"), np.searchsorted(bucket[first], used, "right")
    counts = np.diff(first, append=len(node)).astype("<u4")
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), kind, np.int32)), planes(h.astype("<u8"), ends, width), planes(node[first].astype("<i8"), node_ends, node_width), planes(counts, node_ends, 4)], names=names(DEALT))


def _dealt(rows: zip, width: int, node_width: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and documents of packed rows."""
    h, node = [], []
    for tokens, nodes, counts in rows:
        h.append(unplaned(tokens, width, "<u8"))
        node.append(np.repeat(unplaned(nodes, node_width, "<i8"), unplaned(counts, 4, "<u4")))
    return np.concatenate(h), np.concatenate(node)


def _prefixes(level: np.ndarray, buckets: int):
    """A task's hash prefixes by bucket; equal sets of a task are one document.  Kind 1: facts of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], int] = {}  # set -> first document, within what is held
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n
            h, node = (np.concatenate(x) for x in zip(*held))
            held.clear()
            known.clear()
            n = 0
            yield _deal(0, (h % np.uint64(buckets)).astype(np.int32), h // np.uint64(buckets), node, SHORT, SHORT)

        for batch in steps(batches, "text"):
            nodes = batch.column("node").to_numpy()
            h, owner = sets([t or b"" for t in raw(batch.column("text"))])
            sizes = np.bincount(owner, minlength=len(nodes))
            key_a, key_b = _keys(h, owner, len(nodes))
            same, fresh = nodes.copy(), np.zeros(len(nodes), bool)
            for i in np.flatnonzero(sizes):
                key = int(key_a[i]), int(key_b[i])
                fresh[i] = key not in known
                same[i] = known.setdefault(key, int(nodes[i]))
            use = (np.arange(len(h)) - np.searchsorted(owner, owner) < reach(sizes)[owner]) & fresh[owner]
            h, owner = h[use], owner[use]
            hot = level[_cell(h)] > 0
            need = extra(sizes) - np.bincount(owner[hot], minlength=len(nodes))
            doc = batch.column("doc")
            facts = np.column_stack([nodes, doc.fill_null(0).to_numpy(), sizes, same, need, doc.is_null().to_numpy(zero_copy_only=False)])
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array([int(nodes[0] % buckets + turn) % buckets], pa.int32()), pa.array([1], pa.int32()), pa.array([b""], pa.binary()), pa.array([facts.astype("<i8").tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=names(DEALT))
            if not hot.all():
                held.append((h[~hot], nodes[owner[~hot]]))
                n += len(held[-1][0])
            if n >= HELD:
                yield from flush()
        if n:
            yield from flush()

    return run


def _keys(h: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Each set as two sums of mixed members: equal for equal sets."""
    out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    first = runs(owner)
    if len(first):
        for key, seed in zip(out, (0, 0x5851F42D4C957F2D)):
            key[owner[first]] = np.add.reduceat(mix(h ^ np.uint64(seed)), first)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: documents (by the low bytes of their keys) and how many members of the bucket they
    share; kind 1: facts."""
    held: list[tuple[bytes, bytes, bytes]] = []
    at = None
    long = lambda x: pa.array(x, pa.int64())

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            h, node = _dealt(held, SHORT, SHORT)
            held.clear()
            order = np.argsort(h, kind="stable")
            h, node = h[order], node[order]
            first = runs(h)
            many = np.diff(first, append=len(h))
            node = np.sort(node[np.repeat(many > 1, many)])
            first = runs(node)
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int32)), long(node[first]), none, none, none, long(np.diff(first, append=len(node)))], names=names(TALLY))
            give_back()

    for batch in batches:
        for b, kind, t, d, c in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if kind:
                x = np.frombuffer(d, "<i8").reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), long(x[:, 0]), pa.array(x[:, 1], pa.int64(), mask=x[:, 5] > 0), long(x[:, 2]), long(x[:, 3]), long(x[:, 4])], names=names(TALLY))
                continue
            if b != at:
                yield from close()
                at = b
            held.append((t, d, c))
    yield from close()


def _low(node: Column) -> Column:
    return node.bitwiseAND(F.lit((1 << 8 * SHORT) - 1))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's set, with its prefixes under both hash orders cut to four bytes a member."""
    for batch in steps(batches, "text"):
        h, owner = sets([t or b"" for t in raw(batch.column("text"))])
        n = batch.num_rows
        sizes = np.bincount(owner, minlength=n)
        size = reach(sizes)
        keys = _keys(h, owner, n)
        other = mix(h ^ np.uint64(OTHER))
        other = other[np.lexsort((other, owner))]
        use = np.arange(len(h)) - np.searchsorted(owner, owner) < size[owner]
        ends = np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sizes)] + [pa.array(k.view(np.int64)) for k in keys] + [sliced(x[use].astype("<u4"), ends) for x in (h, other)] + [sliced(h.astype("<u8"), np.cumsum(sizes))],
            names=names(SETS),
        )


def _all_members(level: np.ndarray, buckets: int):
    """The members of sets by bucket, but for hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n
            h, node = (np.concatenate(x) for x in zip(*held))
            held.clear()
            n = 0
            yield _deal(0, (h % np.uint64(buckets)).astype(np.int32), h // np.uint64(buckets), node, 8, 8)

        for batch in batches:
            for node, t in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist()):
                h = np.frombuffer(t, "<u8")
                h = h[level[_cell(h)] == 0]
                if len(h):
                    held.append((h, np.full(len(h), node, np.int64)))
                    n += len(h)
                if n >= HELD:
                    yield from flush()
        if n:
            yield from flush()

    return run


def _back(h: np.ndarray, node: np.ndarray, rank: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Members with their ranks on their way back to their documents."""
    bucket = (mix(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((node, bucket))
    bucket, h, node, rank = bucket[order], h[order], node[order], rank[order]
    first, used = runs(bucket, node), np.unique(bucket)
    ends, node_ends = np.searchsorted(bucket, used, "right"), np.searchsorted(bucket[first], used, "right")
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(np.zeros(len(used), np.int32)), planes(h, ends, 8), planes(node[first], node_ends, 8), planes(np.diff(first, append=len(node)).astype("<u4"), node_ends, 4), planes(rank.astype("<u8"), ends, RANK_BYTES)],
        names=names(RANKED),
    )


def _ranks(buckets: int):
    """How many documents have each member, for those of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        done: list[tuple[np.ndarray, ...]] = []
        at = None

        def close() -> None:
            if held:
                h, node = _dealt(held, 8, 8)
                held.clear()
                order = np.argsort(h, kind="stable")
                h, node = h[order], node[order]
                first = runs(h)
                many = np.diff(first, append=len(h))
                rank = np.repeat(many, many)
                use = rank > 1
                done.append((h[use] * np.uint64(buckets) + np.uint64(at), node[use], rank[use]))

        def send(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in done) > least:
                yield _back(*(np.concatenate(x) for x in zip(*done)), buckets)
                done.clear()

        for batch in batches:
            for b, t, d, c in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if b != at:
                    close()
                    yield from send(HELD)
                    at = b
                held.append((t, d, c))
        close()
        yield from send(0)

    return run


def _hot_members(level: np.ndarray, buckets: int):
    """Kind 0: the hot members of sets with their ranks; kind 1: the sets' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            tokens = batch.column("tokens").to_pylist()
            bucket = (mix(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used = np.unique(bucket)
            ends = np.searchsorted(bucket[order], used, "right")
            empty = pa.array([b""] * len(used), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.ones(len(used), np.int32)), empty, planes(node[order], ends, 8), planes(n[order].astype("<u4"), ends, 4), empty], names=names(RANKED))
            h = np.frombuffer(b"".join(tokens), "<u8")
            owner = np.repeat(node, n)
            cell = level[_cell(h)]
            if cell.any():
                yield _back(h[cell > 0], owner[cell > 0], cell[cell > 0].astype(np.int64) + HOT, buckets)

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared members of each rarity prefix, with their positions."""
    held: list[tuple[np.ndarray, ...]] = []
    facts: list[tuple[np.ndarray, np.ndarray]] = []
    at = None

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            h, node, rank = (np.concatenate(x) for x in zip(*held))
            nodes, sizes = (np.concatenate(x) for x in zip(*facts))
            first = np.unique(nodes, return_index=True)[1]
            nodes, sizes = nodes[first], sizes[first]
            order = np.lexsort((h, rank, node))
            h, node, rank = h[order], node[order], rank[order]
            new = runs(node, rank, h)
            h, node = h[new], node[new]
            row = np.searchsorted(nodes, node)
            n = sizes[row]
            place = np.arange(len(h)) - np.searchsorted(row, row) + n - np.bincount(row, minlength=len(nodes))[row]
            use = place < prefix_size(n)
            yield pa.RecordBatch.from_arrays([pa.array(h[use].view(np.int64)), pa.array(node[use]), pa.array(n[use].astype(np.int32)), pa.array(place[use].astype(np.int32))], names=names(POSTINGS))
        held.clear()
        facts.clear()
        give_back()

    for batch in batches:
        for b, kind, t, d, c, r in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if b != at:
                yield from close()
                at = b
            nodes, counts = unplaned(d, 8, "<i8"), unplaned(c, 4, "<u4").astype(np.int64)
            if kind:
                facts.append((nodes, counts))
            else:
                held.append((unplaned(t, 8, "<u8"), np.repeat(nodes, counts), unplaned(r, RANK_BYTES, "<i8")))
    yield from close()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose prefixes meet under both hash orders; cut members that match by chance only keep a pair."""
    for batch in batches:
        a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
        keep = np.ones(len(a), bool)
        for order in ("first", "second"):
            for i, (x, y, least) in enumerate(zip(batch.column(f"{order}_a").to_pylist(), batch.column(f"{order}_b").to_pylist(), meeting(n_a, n_b).tolist())):
                keep[i] = keep[i] and np.isin(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")).sum() >= least
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
            both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
            keep.append(WHOLE * both >= LEAST * (len(x) // 8 + len(y) // 8 - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["u", "v"])


def verified(pairs: DataFrame, sets_: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` that are linked, as ``(u, v)``."""

    def with_sets(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets_.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs

    met = with_sets(pairs, "n", "first", "second").mapInArrow(_meet, "a long, b long")
    return with_sets(met, "tokens").mapInArrow(_verify, "u long, v long")


def _bounds(n_x: Column, at_x: Column, n_y: Column, at_y: Column) -> Column:
    """Length and positional bounds of two documents with a common member at these positions."""
    overlap = F.ceil(LEAST * (n_x + n_y) / (WHOLE + LEAST))
    return (WHOLE * F.least(n_x, n_y) >= LEAST * F.greatest(n_x, n_y)) & (F.least(n_x - at_x, n_y - at_y) >= overlap)


def centre_pairs(postings: DataFrame) -> DataFrame:
    """Each document with one other, ``(a, b)``: of the documents that have a shared member first,
    which are the likeliest to link to the rest, the one it shares most members with."""
    c = postings.groupBy("h").agg(F.min(F.struct("at", "node", "n")).alias("c"), F.count("*").alias("many")).where("many > 1").drop("many")
    near = postings.join(c, "h").where((F.col("node") != F.col("c.node")) & _bounds(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at")))
    times = near.groupBy("node", F.col("c.node").alias("centre")).agg(F.count("*").alias("times"))
    best = times.groupBy("node").agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("centre"))
    return best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def open_pairs(postings: DataFrame, found: DataFrame) -> DataFrame:
    """All candidates ``(a, b)`` of different components: a member's documents in blocks against blocks."""
    named = saved(postings.join(found.select(F.col("u").alias("node"), "v"), "node", "left").select("h", "node", "n", "at", F.coalesce("v", "node").alias("part")))
    mixed = named.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high").select("h", "blocks")
    own = named.join(mixed, "h").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    x = own.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    y = own.withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), "other")))
    side = lambda d, s: d.select("h", "block", "other", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "at", "part")])
    near = (F.col("part_x") != F.col("part_y")) & ((F.col("block") < F.col("other")) | (F.col("node_x") < F.col("node_y")))
    both = side(x, "x").join(side(y, "y"), ["h", "block", "other"]).where(near & _bounds(F.col("n_x"), F.col("at_x"), F.col("n_y"), F.col("at_y")))
    return both.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def only(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose ``node`` is among ``keys``, or is not."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_NODES else keys, "node", how)


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row ``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable by links),
    ``node`` (what the row is known by) and ``stays`` (whether it is the first of its component)."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(node_key(F.col(doc_id), F.col(text)).alias("node"), F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(partitions, -(-total // BUCKET_BYTES))
    level = hot_cells(docs)
    tally = saved(docs.mapInArrow(_prefixes(level, buckets), DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_tally, TALLY))
    facts = tally.where("kind = 1").select("node", "doc", "n", "same", F.col("shared").alias("need"))

    shared = tally.where("kind = 0").groupBy(F.col("node").alias("low")).agg(F.sum("shared").alias("shared"))
    open_ = facts.where("n > 0 AND node = same").withColumn("low", _low(F.col("node"))).join(shared, "low", "left").where("coalesce(shared, 0) >= need")
    sets_ = saved(only(docs, saved(open_.select("node").distinct()), "left_semi").mapInArrow(_sets, SETS).dropDuplicates(["node"]))
    first = sets_.groupBy("key_a", "key_b").agg(F.min("node").alias("v"))
    equal = saved(sets_.select("key_a", "key_b", F.col("node").alias("u")).join(first, ["key_a", "key_b"]).where("u <> v").select("u", "v").distinct())
    own = only(sets_, equal.select(F.col("u").alias("node")), "left_anti")

    members = own.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions, -(-8 * members // BUCKET_BYTES))
    by_bucket = lambda x: x.repartition(parts, "bucket").sortWithinPartitions("bucket")
    ranked = by_bucket(own.select("node", "tokens").mapInArrow(_all_members(level, parts), DEALT)).mapInArrow(_ranks(parts), RANKED)
    ranked = ranked.unionByName(own.select("node", "n", "tokens").mapInArrow(_hot_members(level, parts), RANKED))
    postings = saved(by_bucket(ranked).mapInArrow(_postings, POSTINGS))

    several = facts.where("doc IS NOT NULL").groupBy("doc").agg(F.min("node").alias("v"), F.max("node").alias("high")).where("v < high")
    alike = facts.where("node <> same").select(F.col("node").alias("u"), F.col("same").alias("v")).unionByName(facts.join(several, "doc").where("node <> v").select(F.col("node").alias("u"), "v")).unionByName(equal)
    found = components(alike.unionByName(verified(centre_pairs(postings), sets_)))
    more = saved(verified(open_pairs(postings, found), sets_))
    if more.limit(1).count():
        found = components(found.unionByName(more))

    named = facts.join(found.select(F.col("u").alias("node"), "v"), "node", "left").select("node", "doc", "n", F.coalesce("v", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    stays = F.col("doc").eqNullSafe(F.col("component_id")) & (F.col("doc").isNotNull() | (F.col("node") == F.col("root")))
    return named.join(least, "root").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "node", stays.alias("stays"))
