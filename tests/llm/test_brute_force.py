"""Operators of the llm package that SQL cannot express, against plain versions."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gavel.llm import byte_bpe, fingerprints, language, queries, toxicity, url_filters
from gavel.llm.common import mix

from .test_ngram_jaccard import brute

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def remainder(doc_id, n):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % n


def test_token_counts_and_ids(spark, coder, documents):
    ids = {i: coder.encode_ordinary(r.text or "") for i, r in documents.items()}
    assert {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, SF).collect()} == {i: len(x) for i, x in ids.items()}
    rows = queries.op7_byte_bpe(spark, SF).collect()
    assert all(np.frombuffer(r.token_ends, "<i4").tolist() == np.cumsum([len(coder.decode_single_token_bytes(t)) for t in ids[r.doc_id]], dtype=int).tolist() for r in rows)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((documents[i].text or "").encode()).hexdigest()) for i, x in ids.items()}


def plain_rules(rows, min_support, min_confidence):
    """Every antecedent of every labelled row, counted."""
    n, plain, marked = len(rows), Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                plain[s] += 1
                marked[s, label] += 1
    least = math.ceil(min_support * n)
    rules = {(s, label): (both / plain[s], both / n) for (s, label), both in marked.items() if both >= least and both / plain[s] >= min_confidence}
    return {(s, label): v for (s, label), v in rules.items() if not any((t, label) in rules and rules[t, label][0] >= v[0] for k in range(1, len(s)) for t in itertools.combinations(s, k))}


def test_mined_rules_and_verdicts(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        tokens = sorted(r.sample("abcdefgh", r.randrange(1, 6)))
        bad = {"a", "b"} <= set(tokens) or "c" in tokens and r.random() < 0.7
        rows.append((i, tokens, "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "page_id long, tokens array<string>, label string")
    options = {"min_support": 0.03, "min_confidence": 0.6}
    mined = url_filters.mine(df, **options)
    want = plain_rules([x[1:] for x in rows], **options)
    got = {(tuple(sorted(x.antecedent)), x.label): (x.confidence, x.support) for x in mined.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want) and any(len(s) > 1 for s, _ in want)
    repeated = df.unionByName(df.where("page_id < 3")).unionByName(spark.createDataFrame([(900, [], None), (901, ["z"], None)], df.schema))
    judged = url_filters.match(repeated.drop("label"), mined, ["page_id", "tokens"], default="none").collect()
    assert len(judged) == 305
    for x in judged:
        fits = [(*want[s, label], len(s), label) for s, label in want if set(s) <= set(x.tokens)]
        assert x.verdict in ({"none"} if not fits else {f[3] for f in fits if f[:3] == max(fits)[:3]})
        assert x.mined_confidence == (pytest.approx(max(fits)[0]) if fits else None)


def plain_sample(counts, k):
    """One consistent sample, term by term."""
    quantile, log_quantile = fingerprints._gamma()
    best = None
    for word, w in counts.items():
        h = np.uint64(xxhash.xxh3_64_intdigest(word))
        x = int(mix(np.array([h]) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
        r, log_c, b = quantile[x & 0xFFFF], log_quantile[x >> 16 & 0xFFFF], np.float32(x >> 32) * np.float32(2.0**-32)
        t = np.floor(np.float32(math.log(w)) / r + b)
        a = log_c - r * (t - b) - r
        if best is None or a < best[0]:
            best = a, word, int(t)
    return best and best[1:]


def test_fingerprints_against_a_plain_sampler():
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(n)) for n in (0, 1, 5, 60, 61, 200, 200)] + [None]
    texts[4] = texts[3] + " w1"
    made = fingerprints.fingerprints([t or "" for t in texts])
    samples = [[plain_sample(Counter((t or "").encode().lower().split()), k) for k in range(fingerprints.SAMPLES)] for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        alike = [x == y for x, y in zip(samples[i], samples[j])]
        assert (made[i] == made[j]).tolist() == alike
    gamma = fingerprints._gamma()[0].astype(np.float64)
    assert abs(gamma.mean() - 2) < 0.01 and abs(gamma.var() - 2) < 0.02


def test_collision_rate_is_the_generalised_jaccard_similarity():
    r = random.Random(8)
    off = []
    for _ in range(60):
        a = Counter({f"t{i}x{r.random()}": r.randrange(1, 9) for i in range(40)})
        b = Counter({w: max(1, n + r.randrange(-3, 4)) for w, n in a.items() if r.random() < 0.8}) + Counter(f"u{r.random()}" for _ in range(5))
        want = sum((a & b).values()) / sum((a | b).values())
        x, y = fingerprints.fingerprints([" ".join(c.elements()) for c in (a, b)])
        off.append(fingerprints.likeness(x, y) - want)
    assert abs(np.mean(off)) < 4 * 0.5 / math.sqrt(60 * fingerprints.SAMPLES) and np.abs(off).max() < 0.3


LETTERS = regex.compile(r"\p{L}+")


def plain_grams(text, known=None):
    """N-grams of the letters, a boundary before a word that other characters lead to and behind each
    word; none reaches over one.  Letters that no profile has stand for each other."""
    found, text = Counter(), text.lower()
    for m in LETTERS.finditer(text):
        left = m.start() > 0
        word = "".join(c if known is None or c in known else "\2" for c in m.group())
        s = ("\1" if left else "") + word + "\1"
        for n in range(1, language.LONGEST + 1):
            for i in range(len(s) - n + 1):
                if s[i : i + n] != "\1":
                    found[s[i : i + n]] += 1
    return found


def plain_key(gram):
    return tuple([0] * (language.LONGEST - len(gram)) + [ord(c) for c in gram])


def plain_profiles(rows):
    total = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            total.setdefault(lang, Counter()).update(plain_grams(text))
    return {lang: [tuple(map(ord, g)) for g in sorted(c, key=lambda g: (-c[g], plain_key(g)))[:300]] for lang, c in total.items()}


def test_language_profiles_and_distance(spark, documents):
    want = plain_profiles((r.text, r.lang) for r in documents.values() if remainder(r.doc_id, 4) != 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert learned == want
    for r in queries.op3_language(spark, SF).collect():
        score = plain_scores(documents[r.doc_id].text, want)
        best = max(score.values(), default=0)
        assert r.held_out == (remainder(r.doc_id, 4) == 2) and abs(r.score - best) < 1e-9
        assert r.lang_pred == min((x for x in score if score[x] > best - 1e-12), default="und")


def plain_scores(text, profiles):
    """Likeness to each profile; empty for texts without letters."""
    size, known = max(map(len, profiles.values())), {chr(c) for p in profiles.values() for g in p for c in g}
    counts = plain_grams(text or "", known)
    own, scores = sorted(counts, key=lambda g: (-counts[g], plain_key(g)))[:size], {}
    for lang, profile in profiles.items() if own else ():
        ranks = {g: i for i, g in enumerate(profile)}
        scores[lang] = 1 - sum(abs(i - ranks.get(tuple(map(ord, g)), size)) for i, g in enumerate(own)) / (len(own) * size)
    return scores


def plain_features(text, lexicon):
    words = text.decode("utf-8", "replace").split()
    told = [toxicity.plain(w) for w in words]
    weight = [max([lexicon.get(t, 0.0) for t in toxicity.terms(p)] if p else [0.0]) for p, _ in told]
    seed = [any(p.startswith(s) for s in toxicity.SEEDS) for p, _ in told]
    you = [p in toxicity.SECOND_PERSON for p, _ in told]
    near = [(s or w > 0) and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, (s, w) in enumerate(zip(seed, weight))]
    caps = [len(p) > 1 and w.isupper() for w, (p, _) in zip(words, told)]
    hidden = [changed and any(c.isdigit() or c in "@$*" for c in w) for w, (_, changed) in zip(words, told)]
    drawn = [any(a == b == c for a, b, c in zip(p, p[1:], p[2:])) for p, _ in told]
    n, size = max(1, len(words)), max(1, len(text))
    hits = sum(w > 0 for w in weight)
    share = lambda test: sum(map(test, text.decode("latin-1"))) / size
    ascii_ = lambda c: "!" <= c <= "~"
    return [
        sum(seed) / n, math.log1p(sum(seed)), hits / n, max(weight, default=0), math.log1p(hits), sum(weight) / n, sum(you) / n, sum(near) / n, math.log1p(sum(near)),
        share(lambda c: ascii_(c) and c.isupper()), sum(caps) / n, share(lambda c: c == "!"), share(lambda c: c == "?"), share(lambda c: c in "#$%&*@^~=+<>|\\_"), share(lambda c: ascii_(c) and c.isdigit()),
        sum(hidden) / n, sum(drawn) / n, math.log1p(len(words)),
    ]


def test_toxicity_features_and_lexicon(spark, documents):
    r = random.Random(2)
    texts = [(x.text or "").encode() for x in documents.values()][:60] + [b"", b"  "]
    texts += ["".join(r.choice(["you ", "idiot ", "1d10t ", "LOUD ", "sooo ", "é", "中 ", "$", "!", "? ", "a*b "]) for _ in range(80)).encode() for _ in range(60)]
    lexicon = {"=loud": 1.5, "idio": 2.0, "sooo": 0.5}
    words = toxicity.Words(lexicon)
    got = np.vstack([toxicity.features(texts[:70], words), toxicity.features(texts[70:], words)])
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts], atol=1e-5) and got.shape[1] == len(toxicity.NAMES)
    rows = [(" ".join(r.choice(["ugly", "house", "tree", "river", "blargh"] if y else ["house", "tree", "river", "stone"]) for _ in range(12)), y) for y in [0, 0, 1] * 30]
    after, seen = {}, Counter(y for _, y in rows)
    for text, y in rows:
        for before, word in zip(["", *text.split()], text.split()):
            for term in toxicity.terms(word):
                after.setdefault(term, {0: set(), 1: set()})[y].add(before)
    want = {}
    for term, x in after.items():
        ones, zeros = len(x[1]), len(x[0])
        if ones >= 3 and ones >= 0.8 * (ones + zeros):
            want[term] = math.log((ones + 0.5) / (zeros + 0.5)) - math.log(seen[1] / seen[0])
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want) and "=ugly" in want


def test_toxicity_scores_rise_with_the_margin(spark):
    rows = [(i, " ".join(["calm"] * (i % 9)) + (" you blargh" if i % 4 == 0 else " fine day"), int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df)
    odd = df.select("*", F.lit(7.5).alias("prediction"), F.lit("p").alias("probability"), F.lit(1).alias("margin"), F.lit("f").alias("features"))
    out = model.score(odd.unionByName(odd.limit(2))).collect()
    assert len(out) == 302 and all((x.prediction, x.probability, x.margin, x.features) == (7.5, "p", 1, "f") for x in out)
    scores = {y: [x.score for x in out if x.label == y] for y in (0, 1)}
    assert min(scores[1]) > max(scores[0]) and all(0 <= s <= 1 for x in scores.values() for s in x)
    assert model.score(odd.limit(0)).count() == 0


def plain_words(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_pipeline(rows, items):
    """Rows ``(doc_id, text, lang)`` after each of the first four stages."""
    profiles = plain_profiles((t, lang) for _, t, lang in rows)
    rows = [r for r in rows if max(plain_scores(r[1], profiles).values(), default=-1) >= 0.25]
    yield rows
    root = {doc: least for doc, _, least in brute([r[:2] for r in rows])}
    rows = [r for r in rows if root[r[0]] == r[0]]
    yield rows
    split = lambda t: regex.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, left = {}, []
    for i, t, _ in rows:
        w = split(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    for i, t, lang in rows:
        w = split(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        text = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
        if text or not gone:
            left.append((i, text, lang))
    yield left
    windows = {}
    for t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(len(w[k : k + 13]), set()).add(tuple(w[k : k + 13]))
    clean = []
    for r in left:
        w, hit = plain_words(r[1]), set()
        for n, found in windows.items():
            hit |= {p for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in found for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r)
    yield clean


def test_pipeline_stage_by_stage(spark, coder, tmp_path):
    """Every stage, and run(), on the smallest documents with planted rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = [r for r in docs.collect() if r.text and len(r.text.split()) > 60]
    at = docs.columns.index("text")
    made = ["", None, " \n\t", "123 !! 456", known[0].text, known[0].text.replace(known[0].text.split()[30], "changed", 1), " ".join(known[1].text.split()[5:50]), max((t for t in items if t), key=len), "\u4e2d\u6587 \u0416\u0436"]
    rows = [tuple(made[k] if i == at else v for i, v in enumerate(known[k % len(known)])) for k in range(len(made))]
    planted = spark.createDataFrame(rows, docs.schema).withColumn("doc_id", F.monotonically_increasing_id() % 1000 + 10_000_000 + F.xxhash64("text", "n_chars") % 1_000_000)
    docs.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = [(r.doc_id, r.text, r.lang) for r in given.collect()]
    assert len({r[0] for r in plain}) == len(plain)
    now, sizes = given, [len(plain)]
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_pipeline(plain, items)):
        now = corpus_pipeline.saved(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
        assert sorted((r.doc_id, r.text, r.lang) for r in now.collect()) == sorted(want), name
        sizes.append(len(want))
    assert all(a > b for a, b in zip(sizes[:2] + sizes[3:], sizes[1:3] + sizes[4:]))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out.keys() == {r[0] for r in want}
    for i, t, _ in want:
        ids = coder.encode_ordinary(t)
        assert np.frombuffer(out[i].token_ids, "<u4").tolist() == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(out[i].token_ids).hexdigest() and out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
