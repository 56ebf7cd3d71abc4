"""All queries of the library proper, and the SQL that they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rows of one part of a table that is dealt, about.
PART = 250_000
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The tables below a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str, deal: dict[str, tuple[int, str]] | None = None) -> None:
        self.spark, self.folder, self.deal = spark, folder, deal or {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return rows.repartition(*self.deal[name]) if name in self.deal else rows

    def dealt(self, **keys: str) -> Tables:
        """The same tables, those named dealt by a column into parts of about ``PART`` rows.

        What sorts or joins by that column takes the parts as they are, so that the memory of those tasks has one size for
        any input; Spark's own partitions are made by compressed bytes, of which narrow rows need few.  The tasks that deal
        more than 200 parts sort their rows first, as any such shuffle does, and spill what is beyond their share of memory.
        """
        least = self.spark.sparkContext.defaultParallelism
        return Tables(self.spark, self.folder, {n: (max(least, -(-getattr(self, n).count() // PART)), key) for n, key in keys.items()})

    def sql(self, text: str) -> DataFrame:
        """A SELECT over the tables, for inputs that the queries derive from them."""
        used = [n for n in NAMES if re.search(rf"\b{n}\b", text)]
        return self.spark.sql(re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", text.replace("{", "{{").replace("}", "}}")), **{n: getattr(self, n) for n in used})


def query(name: str, sql: str | None = None):
    """Registers a function from Tables to a DataFrame under a name, with its SQL if it has one."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    from . import cases, checks, corpus, governance, ledgers, quality, scalars, sources, streams  # noqa: F401


load()
