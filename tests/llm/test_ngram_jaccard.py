"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from gavel.llm import ngram_jaccard


def shingles(text):
    words = (text or "").encode().split(None)
    words = [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in words]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows):
    """Id, set size and least reachable id of every row; rows of one id are one node."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= 80 * len(sets[i] | sets[j])
            if linked or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def chains(seed, families, length):
    rng = random.Random(seed)
    rows, n = [], 0
    for f in range(families):
        text = [f"w{f}x{i}" for i in range(rng.choice([3, 7, 13, 13, 30, 120, 400]))]
        for _ in range(length):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[at] = f"n{n}y{at}"
                else:
                    text.insert(rng.choice([0, len(text)]), f"n{n}z")
            if rng.random() < 0.3:  # the same words of another family's start
                text[-1:] = ["common", "line", "of", "many", "texts", "here"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [2, 1000])
def test_chains_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_jaccard, "HOT_LEAST", hot)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 3)
    rows = chains(hot, 25, 8) + [(None, ""), (None, None), (None, "w0x0 w0x1 w0x2"), (90_001, " \t\n"), (90_002, "One"), (90_003, "one"), (90_003, "two"), (90_004, "TWO"), (None, "alone of all"), (None, "alone of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_jaccard.classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_one_row_of_each_component_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, "x y"), (None, "x y z")]
    got = ngram_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).where("stays").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None", "None"]


def test_empty_table(spark):
    assert ngram_jaccard.classes(spark.createDataFrame([], "doc_id long, text string, node int")).count() == 0


def test_a_hash_prefix_of_linked_sets_shares_enough():
    for n in range(1, 1500):
        m = np.arange(-(-4 * n // 5), 5 * n // 4 + 1)
        n_ = np.full(len(m), n)
        t = ngram_jaccard.needed(n_, m)
        m, n_, t = m[t <= np.minimum(n_, m)], n_[t <= np.minimum(n_, m)], t[t <= np.minimum(n_, m)]
        assert (ngram_jaccard.meeting(n_, m) >= ngram_jaccard.extra(n_)).all()
        assert (ngram_jaccard.meeting(n_, m) <= ngram_jaccard.reach(n_)).all()
