"""Texts in overlapping chunks, cut at the end of a sentence or word where there is one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import rows_json

#: White space as texts are normalised by; fixed values.
WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Places to cut behind, the best first, and how far before the limit they are looked for; fixed values.
BREAKS = (". ", "; ", ": ", "\n", " ")
REACH = 160


def spans(text: str, longest: int, overlap: int) -> Iterator[str]:
    """The chunks of a text whose white space is single blanks; lengths are in UTF-16 units."""
    units = text if text.isascii() or max(text) < "\U00010000" else "".join(chr(int.from_bytes(p, "little")) for p in _pairs(text.encode("utf-16-le")))
    start = 0
    while True:
        limit = start + longest
        end = len(units)
        if limit < end:
            first = max(start + 1, limit - REACH)
            cut = next((i + len(b) for b in BREAKS if (i := units.rfind(b, first, limit + len(b))) >= 0), limit)
            end = min(cut, end)
        if chunk := units[start:end].strip(" "):
            yield chunk if units is text else chunk.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        if end >= len(units):
            return
        start = max(0, end - overlap)


def _pairs(coded: bytes) -> Iterator[bytes]:
    return (coded[i : i + 2] for i in range(0, len(coded), 2))


def chunk_text(sections: DataFrame, key: str = "section_id", version: str = "version_id", text: str = "text", longest: int = 1_200, overlap: int = 160) -> DataFrame:
    """``(key, version, chunk_ordinal, text, content_hash, chunk_id)``: the chunks of each section.

    Where the next chunk starts depends on where the last one ended, so a text is walked in Python, in batches
    beside the JVM; hashes and ids are made by Spark.  Null texts have no chunk, blank ones a single empty one.
    """
    if not 200 <= longest <= 8_000 or not 0 <= overlap < longest // 2:
        raise ValueError("longest must be within 200 and 8000, overlap below its half")
    blank = F.btrim(F.regexp_replace(text, WHITE, " "), F.lit(" "))

    @F.pandas_udf("array<string>")
    def cut(texts):
        return texts.map(lambda t: None if t is None else list(spans(t, longest, overlap)) or [""])

    rows = sections.select(F.col(key), F.col(version), blank.alias("_t"))
    short = F.octet_length("_t") <= longest
    chunks = F.when(short, F.array("_t")).otherwise(cut(F.when(~short, F.col("_t"))))
    rows = rows.select(key, version, F.posexplode(chunks).alias("chunk_ordinal", "text"))
    named = rows.select(key, version, "chunk_ordinal", "text", F.col("chunk_ordinal").alias("chunkOrdinal"), F.col(key).cast("string").alias("sectionId"), F.col(version).cast("string").alias("sourceVersionId"))
    hashed = named.withColumn("content_hash", F.sha2(rows_json("chunkOrdinal", "sectionId", "sourceVersionId", "text"), 256))
    return hashed.select(key, version, "chunk_ordinal", "text", "content_hash", F.concat_ws(":", "sourceVersionId", "sectionId", F.col("chunk_ordinal").cast("string"), F.substring("content_hash", 1, 16)).alias("chunk_id"))
