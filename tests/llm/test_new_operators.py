"""Whitening, suffix-array dedup and periodic runs against plain versions, and over odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.llm import periodic_runs, queries, suffix_index, whitening

SF = "/root/testdata/sf0.001"


def plain_whitening(vectors):
    x = np.array([np.floor(1024 * np.array(v, float)) + 100_000 for v in vectors]).astype(np.int64)
    n, total = len(x), x.sum(axis=0)
    y = (x * n - total) / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return ((x * n - total) ** 2).sum(axis=1), y @ vectors / np.sqrt(values), values / np.trace(v)


def test_whitening_query(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    deviation, white, explained = plain_whitening([r.embedding for r in rows])
    got = {}
    for r in queries.op11_whitening(spark, SF).collect():
        got[r.vec_id, r.component] = r
    assert len(got) == 8 * len(rows)
    mine = np.array([[got[r.vec_id, c].whitened for c in range(1, 9)] for r in rows])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-8
    assert [got[r.vec_id, 1].deviation for r in rows] == deviation.tolist()
    assert np.abs(np.array([got[rows[0].vec_id, c].explained for c in range(1, 9)]) / explained - 1).max() < 1e-9
    assert {r.n for r in got.values()} == {len(rows)} and max(r.identity_error for r in got.values()) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, 2 * n)) * 100
    for m in (a @ a.T, np.eye(n) * 5, np.diag([3.0] * (n // 2) + [1.0] * (n - n // 2)), np.ones((n, n)), np.zeros((n, n)), a @ a.T * 1e-12):
        values, x = whitening.eigen(m, 8)
        size = max(np.abs(m).max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:8]).max() <= 1e-12 * size
        assert np.abs(m @ x - x * values).max() <= 1e-12 * size and np.abs(x.T @ x - np.eye(len(values))).max() < 1e-12


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [2.0, -1.0, 0.25], [0.0, 3.5, 1.0], [4.0, 1.0, 2.0], [4.0, 1.0, 2.0]]
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1.0], [1.0, 2.0, 3.0, 4.0]]
    df = spark.createDataFrame([(i, v, f"own {i}") for i, v in enumerate(good + odd)] + [(None, good[0], "own")], "vec_id long, embedding array<double>, whitened string")
    model = whitening.fit(df)
    out = model.project(df).collect()
    assert sorted(str(r.vec_id) for r in out) == ["0", "1", "2", "3", "4", "None"] and model.n == 6
    z = np.array([r.whitened for r in out])
    assert z.shape == (6, 3) and np.abs(z.T @ z / 6 - np.eye(3)).max() < 1e-9 and model.identity_error(df) < 1e-9
    equal = spark.createDataFrame([(1, [7, 7]), (2, [7, 7])], "vec_id long, embedding array<long>")
    model = whitening.fit(equal)
    assert [(r.whitened, r.deviation) for r in model.project(equal).collect()] == [([], 0), ([], 0)] and model.identity_error(equal) is None
    none = equal.limit(0)
    model = whitening.fit(none)
    assert model.n == 0 and model.project(none).collect() == [] and model.explained == []
    large = spark.createDataFrame([(1, [2**61, 0]), (2, [-(2**61), 1])], "vec_id long, embedding array<long>")
    assert [r.deviation for r in whitening.fit(large).project(large).collect()] == [None, None]
    exact = spark.createDataFrame([(1, [2**29 + 1, 0]), (2, [1, 1])], "vec_id long, embedding array<long>")
    assert [r.deviation for r in whitening.fit(exact).project(exact).collect()] == [2**58 + 1] * 2


def test_whitening_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op11_whitening(spark, str(tmp_path))
    assert out.collect() == [] and out.dtypes == queries.op11_whitening(spark, SF).dtypes


def plain_repeats(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_suffix_query(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for (d, _), x in zip(docs, plain_repeats([t for _, t in docs]))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_suffix_dedup(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 10_000


def made_text(rng, pool):
    parts = []
    for _ in range(rng.choice([1, 2, 4])):
        kind, letters = rng.random(), rng.choice([1, 2, 4, 26])
        if kind < 0.4:
            parts.append(bytes(rng.randrange(97, 97 + letters) for _ in range(rng.choice([0, 50, 199, 200, 201, 400]))))
        elif kind < 0.8 and pool:
            x = rng.choice(pool)
            i = rng.randrange(max(1, len(x)))
            parts.append(x[i : i + rng.choice([150, 199, 200, 210, 300, 1000])])
        else:
            parts.append((bytes(rng.randrange(97, 123) for _ in range(rng.choice([1, 3, 20, 150]))) * 30)[: rng.choice([199, 200, 250, 700])])
    pool.append(b"".join(parts))
    return pool[-1]


def test_suffix_families(monkeypatch):
    """Many small batches into one family, with few stretches kept of a gram and short pieces."""
    monkeypatch.setattr(suffix_index, "MOST", 3)
    rng = random.Random(3)

    def found(parts):
        family, out, size = suffix_index.Family(), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)], rng.choice([20, 300])
        for p in parts:
            for low in range(0, len(p[0]), size):
                some, stays, _ = suffix_index.meet(suffix_index.picked(p, slice(low, low + size)))
                out += [some, *family.add(stays)]
        doc, _, code = suffix_index.joined(*out)
        return doc, *suffix_index.decoded(code)

    for _ in range(60):
        pool = []
        texts = [made_text(rng, pool) for _ in range(rng.choice([1, 3, 12]))]
        monkeypatch.setattr(suffix_index, "PIECE", rng.choice([1 << 18, 400]))
        doc, at, count, edge = found([(g, x, t, t * 0, suffix_index.encoded(a, c), np.zeros(len(t), np.uint8)) for t, a, c, g, x in suffix_index.anchored(texts)])
        gone = [set() for _ in texts]
        for d, a, c in zip(doc[~edge], at[~edge], count[~edge]):
            gone[d] |= set(range(a, a + c + 199))
        mine = [(doc == d) & edge for d in range(len(texts))]
        parts = suffix_index.windows(texts, [at[m] for m in mine], [count[m] for m in mine])
        doc, at, _, _ = found([(h, h * 0, t, t * 0, suffix_index.encoded(p, np.ones(len(p), int)), np.zeros(len(t), np.uint8)) for t, p, h in parts])
        for d, a in zip(doc, at):
            gone[d] |= set(range(a, a + 200))
        assert [len(x) for x in gone] == [x[1] for x in plain_repeats(texts)]


def odd_texts(rng):
    passage = "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(700))
    return ["", None, " \n", "short", passage, "x" + passage, passage[:300] + "!" + passage[300:], passage, "y" * 3000, passage[5:204], "".join(rng.choice("ab") for _ in range(400_000)) + passage]


def test_suffix_odd_rows(spark):
    rng = random.Random(5)
    texts = odd_texts(rng)
    ids = [None if i in (2, 5) else i for i in range(len(texts))]
    rows = [(d, t, f"own {i}", f"kept {i}") for i, (d, t) in enumerate(zip(ids, texts))]
    rows += [rows[4], rows[0], rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, kept string")
    out = suffix_index.remove_repeats(df).collect()
    want = plain_repeats([(r[1] or "").encode() for r in rows])
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted(((r.doc_id, r.doc, bytes(r.kept), r.n_bytes, len(r.spans)) for r in out), key=key) == sorted(((r[0], r[2], w[3], w[0], w[2]) for r, w in zip(rows, want)), key=key)
    assert suffix_index.remove_repeats(df.limit(0)).collect() == []


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(6, 4 * q) and all(any(x[k] != x[k + d] for k in range(len(x) - d)) for d in range(1, q)):
                out.append((i, len(x), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    some = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = (r.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 5000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        some += len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
        assert got[r.doc_id] == (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed(w, found)).hexdigest())
    assert some > 10


def test_runs_of_made_texts():
    rng = random.Random(5)

    def made():
        k = rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(k) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 200]))]
        for _ in range(rng.choice([0, 1, 3])):
            u = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 17, 30]))]
            i = rng.randrange(len(w) + 1)
            w[i:i] = u * rng.choice([3, 4, 5, 9]) + u[: rng.randrange(len(u) + 1)]
        return w

    for _ in range(300):
        texts = [made() for _ in range(rng.choice([1, 3, 8]))]
        counts = np.array([len(t) for t in texts])
        last = np.cumsum(counts)
        start, end, period = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), np.repeat(last, counts))
        want = [(int(b) + s, length, q) for b, t in zip(last - counts, texts) for s, length, q in plain_runs(t)]
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want


def test_runs_odd_rows(spark):
    rng = random.Random(6)
    texts = ["", None, " \t", "a " * 5, "a " * 6, "a\x0bb\n" * 4, "é ü " * 9 + "x y " * 4, "w " * 300_000, "".join(rng.choice("ab") + " " for _ in range(3000)), "long" * 500_000]
    rows = [(None if i == 4 else i, t, f"own {i}", i) for i, t in enumerate(texts)]
    rows += [rows[6], rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, runs int")
    out = periodic_runs.runs(df).collect()
    want = [(r[0], r[2], len((r[1] or "").split()), [(0, 300_000, 1)] if r[0] == 7 else plain_runs((r[1] or "").encode().split())) for r in rows]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.bucket, r.n_words, [tuple(x) for x in r.runs]) for r in out), key=key) == sorted(want, key=key)
    texts_of = {r.bucket: r.collapsed_text for r in out}
    assert texts_of["own 5"] == "a b" and texts_of["own 7"] == "w" and texts_of["own 1"] == "" and texts_of["own 3"] == "a a a a a"
    assert periodic_runs.runs(df.limit(0)).collect() == []


def test_runs_and_repeats_of_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for query in (queries.op12_suffix_dedup, queries.op13_periodic_runs):
        out = query(spark, str(tmp_path))
        assert out.collect() == [] and out.dtypes == query(spark, SF).dtypes


def test_ids_may_be_null(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    df.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id"))).write.parquet(str(tmp_path / "documents.parquet"))
    for query in (queries.op12_suffix_dedup, queries.op13_periodic_runs):
        assert query(spark, str(tmp_path)).count() == 20
