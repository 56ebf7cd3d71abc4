"""URL filters by association rules, beside a list of host and path rules.

Spark's FP-growth mines combinations of URL tokens from labelled URLs.  Rules
``tokens -> label`` that miss the support or confidence asked for, and rules
that a shorter one makes redundant, are pruned.  An inverted index keyed by
each rule's rarest token finds the rules that a URL fulfils.

Null URLs and URLs without ``://`` have an empty host and path, no tokens and
the default verdict.  Repeated rows each get their own row.  An empty label
table gives no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as ``struct(rule, verdict)``, else null; of equally
    long ones the one with the longer host."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{rest}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens: host labels, path words (runs of digits as ``#``), query keys, the scheme."""
    words = lambda c, pattern: F.filter(F.split(c, pattern), lambda x: x != "")
    tag = lambda t, c: F.transform(c, lambda x: F.concat(F.lit(t), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(words(query, "&"), lambda x: F.split(x, "=", 2)[0])
    parts = F.concat(
        tag("host:", words(host_, r"[.:@]")),
        tag("path:", words(F.regexp_replace(F.lower(path_), "[0-9]+", "#"), r"[/._+-]|%20")),
        tag("key:", keys),
        tag("scheme:", F.array(F.lower(F.substring_index(url, "://", 1)))),
    )
    return F.when(host_ != "", F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.5) -> DataFrame:
    """Rules ``(antecedent, label, confidence, support)`` from rows ``(tokens, label)``.

    Support is that of the tokens with the label, over all labelled rows.
    """
    label = F.concat(F.lit("label:"), F.col("label"))
    rows = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select(F.concat("tokens", F.array(label)).alias("items"))
    n = rows.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, label string, confidence double, support double, rarest string")
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(rows).freqItemsets
    sets = sets.select(F.array_sort("items").alias("items"), "freq")
    labels = F.filter("items", lambda x: x.startswith("label:"))
    marked = sets.where((F.size(labels) == 1) & (F.size("items") > 1)).select(F.filter("items", lambda x: ~x.startswith("label:")).alias("antecedent"), F.substring(labels[0], 7, 1 << 20).alias("label"), F.col("freq").alias("both"))
    plain = sets.where(F.size(labels) == 0)
    rules = marked.join(plain, marked.antecedent == plain["items"]).select("antecedent", "label", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(n)).alias("support"))
    rules = rules.where(F.col("confidence") >= min_confidence)
    # A rule is redundant if one with fewer of its tokens is at least as sure of the same label.
    single = plain.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_freq"))
    shorter = rules.select(F.col("antecedent").alias("short"), F.col("label").alias("short_label"), F.col("confidence").alias("short_confidence"), F.explode("antecedent").alias("token"))
    longer = rules.where(F.size("antecedent") > 1).select("antecedent", "label", "confidence", F.explode("antecedent").alias("token"))
    redundant = longer.join(shorter, "token").where((F.col("label") == F.col("short_label")) & (F.col("short_confidence") >= F.col("confidence")) & (F.size("short") < F.size("antecedent")) & (F.size(F.array_except("short", "antecedent")) == 0)).select("antecedent", "label").distinct()
    rules = rules.join(redundant, ["antecedent", "label"], "left_anti")
    rare = rules.select("antecedent", "label", "confidence", "support", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent", "label", "confidence", "support").agg(F.min_by("token", F.struct("token_freq", "token")).alias("rarest"))
    return rare


def match(urls: DataFrame, rules: DataFrame, key: list[str], default: str = "allow") -> DataFrame:
    """Adds ``mined_rule``, ``mined_confidence`` and ``verdict`` by the surest fulfilled rule
    (then higher support, then more tokens, then text) to rows with ``tokens``."""
    index = rules.select(F.col("rarest").alias("token"), "antecedent", "label", "confidence", "support")
    hits = urls.select(*key, "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("confidence", "support", F.size("antecedent"), F.concat_ws(" ", "antecedent"), "label")
    best = hits.groupBy(*[F.col(k).alias(f"hit_{k}") for k in key]).agg(F.max_by(F.struct(F.concat_ws(" ", "antecedent").alias("mined_rule"), F.col("confidence").alias("mined_confidence"), F.col("label").alias("mined")), rank).alias("hit"))
    same = [F.col(k).eqNullSafe(F.col(f"hit_{k}")) for k in key]
    return urls.join(best, same, "left").drop(*[f"hit_{k}" for k in key]).withColumns({"mined_rule": F.col("hit.mined_rule"), "mined_confidence": F.col("hit.mined_confidence"), "verdict": F.coalesce("hit.mined", F.lit(default))}).drop("hit")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", **options) -> DataFrame:
    """Host, path, listed rule and verdict of every page.

    ``labels`` has ``page_id`` and ``label``; a page with several labels counts with each.
    """
    h, p = host(F.col(url)), path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": h, "path": p}).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = rows.join(labels.select("page_id", "label"), "page_id").select("tokens", "label")
    mined = match(rows, mine(labelled, **options), ["page_id", "url"])
    hit = listed(F.col("host"), F.col("path"), rules)
    return mined.withColumn("listed", hit).select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "verdict").alias("verdict"), "mined_rule", "mined_confidence")
