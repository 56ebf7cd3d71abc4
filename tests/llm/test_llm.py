"""Operators of the llm package against brute force, on small inputs with odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from gavel.llm import byte_bpe, decontamination, fingerprints, language, lm_scoring, ngram_jaccard, substring_dedup, token_counts, toxicity, url_filters
from gavel.llm.common import shared_dir

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, found string"


def words(n, seed, size=40):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}x{r.randrange(9)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with nulls, empty and long ones, copies, near copies, shared passages, a name clash."""
    base, passage = words(60, 1, 500), words(30, 2, 500)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:58] + ["new", "end"])), (4, None), (5, ""), (6, "   \n"), (7, "Short text"), (8, "short TEXT")]
    rows += [(9, " ".join(words(40, 3, 500) + passage)), (10, " ".join(passage + words(50, 4, 500))), (11, " ".join(words(20_000, 5, 2000))), (12, "don't  I'll\t'sé 中文 123!!" * 3), (12, "other text of one id"), (13, " ".join(["same"] * 100))]
    rows += [(20 + i, " ".join(base[: 60 - i] + words(i, 50 + i, 500))) for i in range(12)]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).repartition(3).cache()


def texts_of(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


def test_bpe(docs):
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == coder.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(ids) and r.found == "x"
        ends = np.frombuffer(r.token_ends, "<i4")
        assert (ends[-1] if len(ends) else 0) == len((r.text or "").encode())


def test_bpe_random_texts():
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    own, r = byte_bpe.Encoder(RANKS), random.Random(7)
    for _ in range(100):
        texts = ["".join(r.choice("  \t\n''abcstmdrvleSRE019!?.é 中\u0000") for _ in range(r.randrange(60))) for _ in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [coder.encode_ordinary(t) for t in texts]
    assert np.frombuffer(own.encode(["a" * 3000])[0], "<u4").tolist() == coder.encode_ordinary("a" * 3000)


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids, parent = list(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_ngram_jaccard(docs):
    got = {r.doc_id: r.component_id for r in ngram_jaccard.classes(docs).collect()}
    assert got == brute_classes(texts_of(docs))
    assert ngram_jaccard.classes(docs.limit(0)).count() == 0


def test_many_near_copies(spark):
    r, base = random.Random(3), words(80, 9, 900)
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(r.randrange(1, 6)):
            own[r.randrange(80)] = f"edit{r.randrange(4000)}"
        rows.append((i, " ".join(own), None))
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in ngram_jaccard.classes(df).collect()} == brute_classes([(i, t.encode()) for i, t, _ in rows])


def test_chains_of_short_texts(spark):
    """The last of three texts is at exactly 0.8 to both others, which are not linked: groups of two decide.
    Longer texts repeat the others' own shingle, so that all ends are as rare."""
    rows = []
    for f in range(60):
        own = [f"f{f}w{k}" for k in range(13)]
        left, right = own[:-1] + [f"f{f}x"], [f"f{f}y"] + own[1:]
        rows += [(9 * f, " ".join(left)), (9 * f + 1, " ".join(right)), (9 * f + 2, " ".join(own))]
        rows += [(9 * f + 3 + k, " ".join(part + [f"f{f}z{k}x{j}" for j in range(20)])) for k, part in enumerate((left[-5:], right[:5]))]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(i, t, None) for i, t in rows], DOCS)
    assert {r.doc_id: r.component_id for r in ngram_jaccard.classes(df).collect()} == brute_classes([(i, t.encode()) for i, t in rows])


def test_substring_dedup(docs):
    rows = texts_of(docs)
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    out = substring_dedup.remove_repeats(docs)
    assert "found" in out.columns and sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == sorted(want)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, " ".join(words(30, 2, 500))), (2, "SHORT text"), (3, None), (4, "!!"), (4, "one")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, items).collect()}
    assert got[(9, 70)] == (30, 1, True) and got[(10, 80)] == (30, 1, True) and got[(7, 2)] == (2, 1, True) and got[(8, 2)] == (2, 1, True)
    assert got[(4, 0)] == (0, 0, False) and got[(1, 60)] == (0, 0, False)
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_language(spark):
    r = random.Random(1)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(80))
    rows = [(i, text("abcde") if i % 2 else text("vwxyz"), "aa" if i % 2 else "zz") for i in range(20)]
    df = spark.createDataFrame(rows + [(90, None, "aa"), (91, "123 !!", None), (92, "", "zz")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, language.learn(df)).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows) and all(got[i] == ("und", 0.0) for i in (90, 91, 92))
    assert {r.lang_pred for r in language.identify(df, language.learn(df.limit(0))).collect()} == {"und"}


def test_fingerprints(spark, docs):
    out = fingerprints.edits(docs).collect()
    assert len(out) == docs.count()
    rows = sorted(texts_of(docs), key=lambda r: (-r[0], hashlib.sha256(r[1]).hexdigest()))
    texts = [t.decode() for _, t in rows]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + texts[(i + 1) % len(texts)][: len(t) // 3]).encode()).hexdigest() for i, t in enumerate(texts))
    assert sorted(r.edited_sha256 for r in out) == want
    a, b = " ".join(words(300, 1, 50)), " ".join(words(200, 1, 50))
    x, y = fingerprints.fingerprints([a, b])
    ca, cb = ({w: t.split().count(w) for w in set(t.split())} for t in (a, b))
    j = sum(min(ca.get(w, 0), cb.get(w, 0)) for w in ca | cb) / sum(max(ca.get(w, 0), cb.get(w, 0)) for w in ca | cb)
    assert abs(fingerprints.likeness(x, y) - j) < 0.2
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_chars) for r in fingerprints.edits(one).collect()] == [(None, 0)]


def test_token_counts(spark, docs):
    folder = shared_dir(spark)
    order = token_counts.write_tokens(docs, folder, RANKS, 50_256)
    counts = token_counts.scan(spark, folder, 50_256, order, block_tokens=37)
    got = sorted((r.doc_id, r.n_tokens) for r in order.join(counts, ["file", "ordinal"]).collect())
    assert got == sorted((r.doc_id, r.n_tokens) for r in byte_bpe.encode(docs, RANKS).collect())


def test_lm_scoring(spark, docs):
    from collections import Counter

    rows = docs.where("doc_id <> 12")
    got = {r.doc_id: r for r in lm_scoring.score(rows, rows.where("doc_id < 11")).collect()}
    counts = Counter()
    for i, t in texts_of(rows):
        if i < 11:
            counts.update(t.lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts_of(rows):
        tokens = t.lower().split() + [None]
        want = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        assert abs(got[i].base_score - want) < 1e-6 * max(1, -want) and got[i].n_tokens == len(tokens) and got[i].n_known == sum(counts[x] > 0 for x in tokens) and got[i].train_tokens == n and got[i].score < 0
    assert lm_scoring.score(rows, rows.limit(0)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_lm_scoring_knows_rare_contexts(spark, docs, monkeypatch):
    """Every context counts, also where the automaton keeps only the most frequent ones."""
    from collections import Counter, defaultdict

    rows = docs.where("doc_id not in (11, 12)")
    seen, order = defaultdict(Counter), lm_scoring.ORDER
    ngrams = lambda t: [(x[i - k : i], x[i]) for x in [b"\xff" * order + t + b"\xff"] for i in range(order, len(x)) for k in range(order, -1, -1)]
    for i, t in texts_of(rows):
        if i < 20:
            for context, symbol in ngrams(t):
                seen[context][symbol] += 1

    def brute(t):
        total, parts = 0.0, ngrams(t)
        for at in range(0, len(parts), order + 1):
            p, gone = 1.0, set()
            for context, symbol in parts[at : at + order + 1]:
                left = {s: c for s, c in seen.get(context, {}).items() if s not in gone}
                size = sum(left.values()) + len(left)
                if not gone and seen.get(context) or left:
                    p *= (left[symbol] if symbol in left else len(left)) / size
                    if symbol in left:
                        break
                    gone |= left.keys()
            else:
                p /= 256 - len(gone)
            total += np.log10(p)
        return total

    want = {i: brute(t) for i, t in texts_of(rows)}
    for kept in (2.0**-18, 0.002):
        monkeypatch.setattr(lm_scoring, "KEPT", kept)
        got = {r.doc_id: r.score for r in lm_scoring.score(rows, rows.where("doc_id < 20")).collect()}
        assert all(abs(got[i] - x) < 1e-4 * max(1, -x) for i, x in want.items())


def test_model_sums_to_one():
    codes = lm_scoring._codes([b"the cat sat on the mat", b"the dog", b""])
    keys, counts = np.unique(codes, return_counts=True)
    tables = {k: lm_scoring._merged(keys & np.uint64((1 << 8 * (k + 1)) - 1), counts) for k in range(2, lm_scoring.ORDER + 1)}
    model = lm_scoring.Automaton(tables, 1)
    p = 10.0 ** model.cost.reshape(-1, model.width).astype(np.float64)
    unseen = 256 - (model.width - 1)
    assert np.allclose(p[:, :-1].sum(axis=1) + unseen * p[:, -1], 1, atol=1e-4)
    assert lm_scoring.adaptive_score(b"abababababab") > 2 * lm_scoring.adaptive_score(b"ab") * 3


def test_toxicity(spark):
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join(words(30, i, 300) + (["you", "blargh"] * 2 if bad else [])), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    odd = spark.createDataFrame([(900, None, None), (901, "", None)], "doc_id long, text string, label int")
    model = toxicity.fit(df.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in model.score(df.unionByName(odd)).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.95 and all(0 <= got[i] <= 1 for i in (900, 901))
    assert toxicity.fit(odd).score(odd).count() == 2


def test_url_filters(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    urls = [(1, "http://A.Example.NET/en/1", "example.net/en/"), (2, "https://x.net/a?b", "net/"), (3, "http://net?x=/", None), (4, None, None), (5, "no scheme", None), (6, "http://b.org/fr/x#y", "org/fr/"), (6, "http://b.org/fr/x#y", "org/fr/"), (7, "http://xexample.com/de/", None)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in urls], "page_id long, url string")
    labels = spark.createDataFrame([(1, "allow"), (2, "block"), (7, "block")], "page_id long, label string")
    got = sorted((r.page_id, r.host, r.rule) for r in url_filters.judge(pages, labels, rules).collect())
    hosts = {1: "a.example.net", 2: "x.net", 3: "net", 4: "", 5: "", 6: "b.org", 7: "xexample.com"}
    assert got == sorted((i, hosts[i], rule) for i, _, rule in urls)
    assert url_filters.judge(pages, labels.limit(0), rules).where(F.col("rule").isNull() & (F.col("verdict") != "allow")).count() == 0


def test_url_rules_of_four_tokens(spark):
    """Four tokens together are surer than any three of them."""
    four = ["a", "b", "c", "d"]
    rows = [(four, "block")] * 10 + [([t for t in four if t != x], "allow") for x in four for _ in range(4)]
    rules = url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert [sorted(r.antecedent) for r in rules.collect() if r.label == "block" and r.confidence == 1] == [four]


def test_pipeline(spark):
    """What is left are least ids of near-duplicate classes; test_brute_force holds every stage against a plain version."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    least = brute_classes([(i, (t or "").encode()) for i, t in rows.items()])
    left = {r.doc_id for r in out}
    assert left <= {i for i, root in least.items() if i == root} and len(left) > 0.5 * len(rows)
    assert all(hashlib.sha256(r.token_ids).hexdigest() == r.ids_sha256 for r in out)
