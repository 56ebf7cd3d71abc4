"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learned from labelled
texts, second-person words near lexicon hits, capitals, punctuation and
obfuscated spellings.  Spark ML fits the trees and the calibration.

Nulls and empty texts have no words: all features are 0 and they are scored
like any text.  Unlabelled rows (null label) do not take part in learning.  If
the labelled rows hold one class or none, every score is that class's share
(0.5 without labels).  Repeated rows each get their own row.

``fit`` learns from at most about ``MAX_LABELLED`` labelled texts, taken by a
hash of the id; everything is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hidden, raw, replace_columns, small_batches, steps

#: Bound of the labelled sample that the models are fitted on.
MAX_LABELLED = 20_000
#: Parts of the sample: learning the lexicon, the trees, the calibration.
SHARES = (50, 30, 20)
#: Stems of insults in four languages.
SEEDS = "idiot moron stupid dumb scum loser trash worthless pathetic disgusting clown jerk bastard arschloch dummkopf trottel depp abschaum connard imbécile crétin ordure débile idiota imbécil estúpido basura tonto gilipollas".split()
STEMS = tuple(SEEDS)
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine euch ihr ihre sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su sus".split())
#: Letters that digits and signs stand for.
LEET = str.maketrans("013457@$!|", "oieastasil")
NEAR = 5
PREFIXES = (4, 5, 6)
NAMES = "seed_rate seeds learned_rate learned_top learned learned_sum you_rate near_rate near caps_rate caps_words exclaim question signs digits hidden_rate drawn_rate words".split()

_DRAWN = re.compile(r"(.)\1\1")
_EDGE = re.compile(r"^\W+|\W+$")


def plain(word: str) -> tuple[str, bool]:
    """A word without signs, look-alikes resolved; whether that changed its inside."""
    inner = word.lower()
    if inner.isalpha():
        return inner, False
    inner = _EDGE.sub("", inner)
    if not inner or inner.isalpha():
        return inner, False
    if not any(map(str.isalpha, inner)):
        return "", False
    told = "".join(c for c in inner.translate(LEET) if c.isalpha())
    return told, True


def terms(word: str) -> list[str]:
    """What the learned lexicon may hold of a plain word: itself and its first letters."""
    return [f"={word}"] + [word[:n] for n in PREFIXES if len(word) > n]


class _Numbers(dict):
    """Numbers keys as they come; ``new`` lists those that have not been taken yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Words:
    """Features of words, kept by word."""

    COLUMNS = 7  # seed, learned weight, learned, second person, capitals, hidden, drawn

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.index, self.rows = lexicon, _Numbers(), []
        self.table = np.zeros((0, self.COLUMNS), np.float32)

    def _features(self, raw_word: bytes) -> tuple[float, ...]:
        word = raw_word.decode("utf-8", "replace")
        told, hidden = plain(word)
        weight = max(map(self.weight, terms(told))) if told else 0.0
        return (told.startswith(STEMS), weight, weight > 0, told in SECOND_PERSON, len(told) > 1 and word.isupper(), hidden and any(c.isdigit() or c in "@$*" for c in word), _DRAWN.search(told) is not None)

    def weight(self, term: str) -> float:
        return self.lexicon.get(term, 0.0)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > 400_000:
            self.index, self.rows = _Numbers(), []
            self.table = self.table[:0]
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self.rows.extend(map(self._features, self.index.new))
            self.index.new.clear()
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.float32)])
        return self.table[at]


def _bytes_by_class() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for i in range(33, 127):
        c = chr(i)
        kinds[i] = 1 if c.isupper() else 2 if c == "!" else 3 if c == "?" else 4 if c in "#$%&*@^~=+<>|\\_" else 5 if c.isdigit() else 0
    return kinds


KINDS = _bytes_by_class()


def features(texts: list[bytes], words: Words) -> np.ndarray:
    """(texts, len(NAMES)) dense features."""
    n = len(texts)
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split])
    table = words([w for s in split for w in s])
    doc = np.repeat(np.arange(n), sizes)
    total = np.maximum(1, sizes)
    add = lambda x: np.bincount(doc, x, n) if len(doc) else np.zeros(n)
    seed, weight, learned, you, caps, hidden, drawn = (table[:, i] for i in range(Words.COLUMNS))
    ends = np.cumsum(sizes)
    reach = np.concatenate([[0], np.cumsum(you)])
    at = np.arange(len(doc))
    low = np.maximum(at - NEAR, (ends - sizes)[doc]) if len(doc) else at
    high = np.minimum(at + NEAR + 1, ends[doc]) if len(doc) else at
    near = (reach[high] - reach[low] > 0) & ((seed > 0) | (learned > 0))
    top = np.zeros(n)
    np.maximum.at(top, doc[weight > 0], weight[weight > 0])
    lengths = np.array([len(t) for t in texts])
    kinds = KINDS[np.frombuffer(b"".join(texts), np.uint8)]
    hit = np.flatnonzero(kinds)
    counts = np.bincount(np.repeat(np.arange(n), lengths)[hit] * 6 + kinds[hit], minlength=n * 6).reshape(n, 6) if len(hit) else np.zeros((n, 6))
    chars = np.maximum(1, lengths)[:, None]
    seeds, hits, nears = add(seed), add(learned), add(near.astype(np.float64))
    cols = [seeds / total, np.log1p(seeds), hits / total, top, np.log1p(hits), add(weight) / total, add(you) / total, nears / total, np.log1p(nears), counts[:, 1] / chars[:, 0], add(caps) / total]
    return np.column_stack(cols + [counts[:, k] / chars[:, 0] for k in (2, 3, 4, 5)] + [add(hidden) / total, add(drawn) / total, np.log1p(sizes)])


def with_features(df: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """Adds ``features`` (array of doubles, in the order of NAMES) and drops the text."""
    small_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (text, "features")] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in steps(batches, text):
            got = features([t or b"" for t in raw(batch.column(text))], words)
            yield replace_columns(batch, [text], features=pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), got.shape[1]).cast(pa.list_(pa.float64())))

    return df.mapInArrow(run, schema)


def learn_lexicon(labelled: DataFrame, text: str = "text", label: str = "label", least: int = 3, min_share: float = 0.8) -> dict[str, float]:
    """Terms that mark label 1, with their log odds.

    A term counts once for each word it follows, so that copies of one text
    count once.  Terms seen behind fewer than ``least`` words in texts of label
    1, or with less than ``min_share`` of such, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            seen: set[tuple[str, str, int]] = set()
            for t, y in zip(batch.column(text).to_pylist(), batch.column(label).to_pylist()):
                before = ""
                for word in (t or "").split():
                    told = plain(word)[0]
                    if told:
                        seen.update((term, before, y) for term in terms(told))
                    before = told
            columns = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["term", "before", "y"])

    rows = labelled.select(text, F.col(label).cast("int").alias(label))
    schema = "term string, before string, y int"
    # First the texts of label 1, which are few; then only their frequent terms elsewhere.
    marked = rows.where(F.col(label) == 1).mapInArrow(run, schema).distinct().groupBy("term").agg(F.count("*").alias("ones")).where(F.col("ones") >= least)
    clean = rows.where(F.col(label) == 0).mapInArrow(run, schema).join(marked.select("term"), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("zeros"))
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    both = marked.join(clean, "term", "left").select("term", "ones", F.coalesce("zeros", F.lit(0)).alias("zeros")).where(F.col("ones") >= min_share * (F.col("ones") + F.col("zeros")))
    base = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return {r["term"]: math.log((r["ones"] + 0.5) / (r["zeros"] + 0.5)) - base for r in both.collect()}  # from a bounded sample


def part(doc_id: Column) -> Column:
    """0 to 99 by a hash of the id: the part of the labelled sample that a row belongs to."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("part")), F.lit(100))


class Model:
    """A lexicon, trees and a calibration; or a constant."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, constant: float) -> None:
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Replaces the text by ``score``, 0 to 1; a column of that name is replaced, all others stay."""
        rows, back = hidden(df, text)
        keep = [c for c, name in zip(back, df.columns) if name not in (text, "score")]
        if self.trees is None:
            return rows.select(*keep, F.lit(self.constant).alias("score"))
        rows = with_features(rows, self.lexicon).withColumn("features", array_to_vector("features"))
        rows = self.calibration.transform(_raw_score(self.trees.transform(rows)))
        return rows.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")).alias("score"))


def _raw_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("margin", vector_to_array("probability")[1])


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from rows with a label of 0 or 1; at most about ``max_labelled`` of them."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(doc_id, text, F.col(label).cast("double").alias("label"))
    counts = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        return Model({}, None, None, float(next(iter(counts), 0.5)))
    if n > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    a, b = SHARES[0], SHARES[0] + SHARES[1]
    lexicon = learn_lexicon(rows.where(part(F.col(doc_id)) < a), text)
    ready = with_features(rows.select(doc_id, text, "label"), lexicon, text).select(doc_id, "label", array_to_vector("features").alias("features")).where(part(F.col(doc_id)) >= a).persist()
    train, rest = ready.where(part(F.col(doc_id)) < b), ready.where(part(F.col(doc_id)) >= b)
    if train.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
        train = rest = ready
        if ready.select("label").distinct().count() < 2:
            return Model({}, None, None, counts.get(1, 0) / n)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, seed=7, checkpointInterval=-1).fit(train)
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(_raw_score(trees.transform(rest)).select("margin", "label"))
    ready.unpersist()
    return Model(lexicon, trees, calibration, counts.get(1, 0) / n)
