"""Benchmark decontamination as a prefix-filtered join, in DataFrame operations only.

Items are cut into windows of consecutive words; a document is hit where a
window occurs in it.  A window is a set of word shingles ordered by rarity
over all documents.  As the whole window must be contained, the necessary
prefix is its rarest shingle: documents join on that one.  A window whose
rarest shingle occurs nowhere is dropped.  The place of the shingle in the
window gives the one place where the window may start; bounds on start and
length are checked first, then the words themselves.

Words are the runs of digits, a-z and code points from U+0080 on, A-Z
lower-cased.  Null and empty texts have no words and are never contaminated;
items without words have no windows.  Repeated rows of documents each get
their own row; a repeated item counts once by its id, one without an id hits
but is not listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Upper-case letters that ``lower`` changes but the operator keeps.
OTHER_UPPER = r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}]]"
WINDOW, SHINGLE = 13, 3
#: The windows are broadcast up to this size, else joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    lowered = F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def shingle(words_: Column, at: Column, k: int) -> Column:
    """Hash of ``k`` words from the 0-based position on."""
    return F.xxhash64(F.lit(k), *[F.get(words_, at + i) for i in range(k)])


def places(words_: Column, k: int, window: int | None = None) -> Column:
    """0-based starts of all runs of ``window`` (default ``k``) words."""
    n = F.size(words_)
    return F.when(n >= (window or k), F.sequence(F.lit(0), n - (window or k))).otherwise(F.array().cast("array<int>"))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(item_id, words)`` of every window: ``window`` words, or all of an item of fewer."""
    cut = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("all")).where(F.size("all") > 0)
    n = F.size("all")
    starts = F.when(n > window, F.sequence(F.lit(0), n - window)).otherwise(F.array(F.lit(0)))
    return cut.select("item_id", "all", F.explode(starts).alias("start")).select("item_id", F.slice("all", F.col("start") + 1, F.lit(window)).alias("words")).distinct()


def shingles(windows_: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(item_id, words, k, at, h)``: every shingle of every window; windows of fewer words have one."""
    parts = []
    for size in range(1, k + 1):
        own = windows_.where(F.size("words") >= k if size == k else F.size("words") == size)
        parts.append(own.select("item_id", "words", F.lit(size).alias("k"), F.explode(places(F.col("words"), size)).alias("at")).withColumn("h", shingle(F.col("words"), F.col("at"), size)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _flags(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A table of bytes, 1 at the low bits of each hash, to skip most other shingles early.
    Its size is bounded, however many hashes there are."""
    bits = max(16, min(20, math.ceil(math.log2(32 * max(1, n)))))
    table = bytearray(1 << bits)
    for row in hashes.select(F.col("h").bitwiseAND((1 << bits) - 1).cast("int").alias("i")).distinct().toLocalIterator():
        table[row["i"]] = 1
    return F.lit(bytes(table)), (1 << bits) - 1


def candidates(words_: Column, sizes: list[int], flags: Column, mask: int) -> Column:
    """Places ``struct(k, at)`` of a document whose shingle may be wanted."""

    def of(k: int) -> Column:
        wanted = F.filter(places(words_, k), lambda i: F.substring(flags, shingle(words_, i, k).bitwiseAND(mask).cast("int") + 1, 1) == F.lit(b"\x01"))
        return F.transform(wanted, lambda i: F.struct(F.lit(k).alias("k"), i.alias("at")))

    return F.concat(*[of(k) for k in sizes])


def _hash_at(words_: Column, place: str, sizes: list[int]) -> Column:
    out = None
    for k in sizes:
        h = shingle(words_, F.col(f"{place}.at"), k)
        out = F.when(F.col(f"{place}.k") == k, h) if out is None else out.when(F.col(f"{place}.k") == k, h)
    return out


def rarest(windows_: DataFrame, documents: DataFrame, text: str = "text") -> tuple[DataFrame, list[int]]:
    """One shingle for each window, the rarest over all documents: ``(item_id, words, k, at, h)``."""
    every = shingles(windows_).persist()
    distinct = every.select("k", "h").distinct().persist()
    sizes = sorted(r["k"] for r in distinct.select("k").distinct().collect())
    n = distinct.count()
    if not sizes:
        return every, sizes
    flags, mask = _flags(distinct, n)
    found = documents.select(words(F.col(text)).alias("w")).select("w", F.explode(candidates(F.col("w"), sizes, flags, mask)).alias("p")).select(_hash_at(F.col("w"), "p", sizes).alias("h"))
    known = F.broadcast(distinct) if n * 32 <= BROADCAST_BYTES else distinct
    counts = found.groupBy("h").agg(F.count("*").alias("n")).join(known.select("h").distinct(), "h", "left_semi")
    ranked = every.join(counts, "h", "left").groupBy("item_id", "words").agg(F.min_by(F.struct("k", "at", "h"), F.struct(F.coalesce("n", F.lit(0)), "h", "at")).alias("s"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return ranked.where(F.col("n") > 0).select("item_id", "words", "s.k", "s.at", "s.h"), sizes


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document its words, its hit words, and the items of which windows occur.

    ``contaminated``: some word is hit, and at least a twentieth of the words.
    """
    from .common import saved

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))
    anchors, sizes = rarest(windows(items, item_id, item_text, window), documents, text)
    anchors = saved(anchors)
    n = anchors.count()
    if not n:
        found = rows.select("row", "doc_id", "text_hash", "n_words", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("many"), F.lit(None).cast("string").alias("item_id"))
    else:
        flags, mask = _flags(anchors, n)
        reach = window - 1
        spread = rows.select("row", "doc_id", "text_hash", "n_words", "w", F.explode_outer(candidates(F.col("w"), sizes, flags, mask)).alias("p"))
        low = F.greatest(F.col("p.at") - reach, F.lit(0))
        spread = spread.select("row", "doc_id", "text_hash", "n_words", F.col("p.k").alias("doc_k"), F.col("p.at").alias("doc_at"), _hash_at(F.col("w"), "p", sizes).alias("doc_h"), low.alias("low"), F.slice("w", low + 1, F.lit(2 * window)).alias("near"))
        small = n * 8 * window * 6 <= BROADCAST_BYTES
        first, many = F.col("doc_at") - F.col("at"), F.size("words")
        fits = (F.col("doc_h") == F.col("h")) & (F.col("doc_k") == F.col("k")) & (first >= 0) & (first + many <= F.col("n_words"))
        # Compared as text: words hold no blanks.
        fits = fits & (F.concat_ws(" ", F.slice("near", F.greatest(first - F.col("low"), F.lit(0)) + 1, many)) == F.concat_ws(" ", "words"))
        found = spread.join(F.broadcast(anchors) if small else anchors, fits, "left").select("row", "doc_id", "text_hash", "n_words", F.when(many > 0, first).alias("first"), F.when(many > 0, many).alias("many"), "item_id")
    spans = F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "many")))
    grouped = found.groupBy("row", "doc_id", "text_hash", "n_words").agg(spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["many"] - 1)))))
    out = grouped.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "items", "text_hash")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
