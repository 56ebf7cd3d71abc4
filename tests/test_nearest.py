"""Retrieval by block products against a plain version."""

import functools
import math
import random

from gavel.operators import nearest


def test_topk_over_odd_rows_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BYTES", 200)
    monkeypatch.setattr(nearest, "CELLS", 16)
    rng = random.Random(3)
    vector = lambda: rng.choice([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.5, 1.0, 1.5], [rng.random() - 0.5 for _ in range(3)], [0.0, 0.0, 0.0], [1.0, 2.0], None, [1.0, None, 1.0], [1.0, float("nan"), 1.0]])
    chunks = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice(["APPROVED"] * 4 + ["DRAFT", None]), rng.choice([None, "2020", "2021"]), rng.choice([None, "2021", "2022"]), vector()) for i in range(300)]
    queries = [(f"q{i}", rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), rng.choice(["2019", "2020", "2021", None]), vector()) for i in range(60)]
    c = spark.createDataFrame(chunks, "chunk_id long, domain string, jurisdiction string, state string, valid_from string, valid_to string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id string, domain string, jurisdiction string, evaluation_date string, embedding array<double>")
    fine = lambda v: v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        add = lambda x, y: functools.reduce(lambda total, p: total + p[0] * p[1], zip(x, y), 0.0)  # noqa: E731  (sum() would compensate)
        return add(a, b) / (math.sqrt(add(a, a)) * math.sqrt(add(b, b)))

    want = {}
    for name, domain, jurisdiction, date, v in queries:
        if not fine(v):
            continue
        scored = []
        for i, d, j, state, since, until, w in chunks:
            valid = (since is None or date is not None and since <= date) and (until is None or date is not None and date < until)
            if fine(w) and state == "APPROVED" and d is not None and d == domain and j == jurisdiction and valid:
                scored.append((-cosine(v, w), i))
        want |= {(name, rank): i for rank, (_, i) in enumerate(sorted(scored)[:4], 1)}
    got = {(r.query_id, r["rank"]): r.chunk_id for r in nearest.nearest(q, c, 4, ("domain", "jurisdiction")).collect()}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {} and len(want) > 40
    assert nearest.nearest(q.limit(0), c, 4, ("domain", "jurisdiction")).collect() == []
    assert nearest.nearest(q, c.limit(0), 4, ("domain", "jurisdiction")).collect() == []
