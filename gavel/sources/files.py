"""Files as rows: what they are, by extension and by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_values

#: First bytes of PNG and ZIP files, in hexadecimal digits; fixed values.
PNG, ZIP = "89504E470D0A1A0A", "504B0304"
#: Formats by extension; fixed values.
EXPECTED = {".png": "PNG", ".json": "JSON", ".jsonl": "JSONL", ".ndjson": "JSONL", ".xlsx": "XLSX"}
#: Files above this are listed without being read.
MAX_FILE_BYTES = 32 * 1024 * 1024


def read_files(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``(path, bytes, content)`` of all files below a folder; larger ones without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = files.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("bytes"), "content")
    large = files.where(F.col("length") > max_bytes).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def _is_json(text: Column) -> Column:
    return json_values.parsed(text).isNotNull()


def artifact_inventory(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row for each file of ``(path, bytes, content)``: hashes of path and content, extension, detected format, issue
    codes, and VALID, WARNING or ERROR.  PNG and XLSX are known by their first bytes only."""
    name = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    rows = files.withColumns({"_ext": name, "_want": F.try_element_at(known, name), "_head": F.hex(F.substring("content", 1, 8)), "_text": F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))})
    lines = F.filter(F.split("_text", r"\r?\n"), lambda x: F.trim(x) != "")
    many = (F.size(lines) > 0) & F.forall(lines, _is_json)
    prefers_lines = F.col("_want").eqNullSafe(F.lit("JSONL"))
    parsed = F.when(F.col("_text").isNull() | (F.trim("_text") == ""), None).when(prefers_lines & many, "JSONL").when(_is_json(F.col("_text")), "JSON").when(many, "JSONL")
    zipped = F.col("_head").startswith(ZIP)
    found = F.when(F.col("_head") == PNG, "PNG").when(zipped, F.when(F.col("_want") == "XLSX", "XLSX")).otherwise(parsed)
    large, unread = F.col("bytes") > max_bytes, F.col("content").isNull()
    rows = rows.withColumn("_found", F.when(~large & ~unread, found))
    want, valid = F.col("_want"), F.col("_found").isNotNull()
    detected = F.when(large | unread, "UNKNOWN").when(valid, F.col("_found")).when(want.isNull() | zipped, "AUXILIARY").otherwise("UNKNOWN")
    rows = rows.withColumn("detected_format", detected)
    issues = F.when(large, F.array(F.lit("FILE_TOO_LARGE"))).when(unread, F.array(F.lit("FILE_READ_FAILED"))).otherwise(F.array_compact(F.array(
        F.when(~valid, F.when(want.isNull(), "AUXILIARY_FORMAT").otherwise(F.concat(F.lit("INVALID_"), want))),
        F.when((valid & want.isNull()) | (want != F.col("detected_format")), "EXTENSION_CONTENT_MISMATCH"))))
    rows = rows.withColumn("issues", issues)
    grave = F.exists("issues", lambda x: x.startswith("INVALID_") | x.startswith("FILE_"))
    extension = F.when(want.isNotNull() | (F.col("_ext") == ""), F.col("_ext")).otherwise("other")
    return rows.select("path", F.sha2("path", 256).alias("path_hash"), F.when(~large & ~unread, F.sha2("content", 256)).alias("content_hash"), "bytes", extension.alias("extension"), "detected_format", "issues", F.when(grave, "ERROR").when(F.size("issues") > 0, "WARNING").otherwise("VALID").alias("status"))
