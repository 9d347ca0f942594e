"""Toxicity, language-model scores, mixing and URL filters against held-out labels or brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefinder.llm import mixing, ngram, toxicity, urls
from lodefinder.llm.common import read_table
from tests.llm.helpers import ROWS, labels, no_docs, odd_docs

INSULTS = ["idiot", "moron", "loser"]


def insulting(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["th", "re", "on", "er", "in", "ti"], 60), rng.choice(["an", "ed", "es", "ou"], 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[int(rng.integers(60))] = str(rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    return rows, marks


def test_toxicity_on_held_out_labels(spark):
    rows, marks = insulting(900)
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)).collect()
    toxic = {i: t for i, _, t in marks}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and held
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_misspellings_share_vectors():
    rows, marks = insulting(900)
    model = toxicity.train([toxicity.words_of(x) for _, x in rows], np.array([t for *_, t in marks], dtype=np.float32))
    plain, seen, *unseen = model.word_logits(["than", "idiot", "idiott", "id-iot", "idio7", "idiot's"])
    assert all(seen > x > plain for x in unseen)
    words = "then rees oned tian thed reou oned inan".split()
    scored = toxicity.Scorer(model).scores([" ".join(words), " ".join([*words, "idiott!"]), "You. Are, (idio7)"])
    assert scored[0] < 0.5 < min(scored[1:])


def test_vectors_and_softmax_are_trained_together():
    rows, marks = insulting(300)
    bags, y = toxicity.Bags([toxicity.words_of(x) for _, x in rows]), np.array([t for *_, t in marks], dtype=np.float32)
    first = np.random.default_rng(1)
    first.random((toxicity.BUCKETS, toxicity.DIM))
    start = (first.random((toxicity.DIM, 2)) - 0.5) * 2 / np.sqrt(toxicity.DIM)
    vectors, weights, _ = toxicity.descend(bags, y, np.arange(300), np.random.default_rng(1))
    assert np.abs(weights - start).max() > 0.01 and np.abs(vectors).max() > 10 * 0.5 / toxicity.DIM
    assert np.linalg.svd(vectors[np.unique(bags.grams)], compute_uv=False)[1] > 0.5


def test_scores_against_plain_python():
    """Word by word and window by window, with no array over words."""
    rows, marks = insulting(200)
    model = toxicity.train([toxicity.words_of(x) for _, x in rows], np.array([t for *_, t in marks], dtype=np.float32))
    texts = [x for _, x in rows[:30]] + ["", None, "One two. THREE four five six! seven idiot", "x" * 5000]
    turn = model.weights[:, 1] - model.weights[:, 0]
    for text, got in zip(texts, toxicity.Scorer(model).scores(texts), strict=True):
        words, best = [], None
        for w in (text or "").lower().split():
            w = w.strip(toxicity.OUTER)
            if w and w not in words:
                words.append(w)
        for at in range(0, len(words), toxicity.WINDOW):
            part = words[at : at + toxicity.WINDOW]
            margin = sum(float(model.vectors[toxicity.grams_of([w])[0]].mean(axis=0) @ turn) for w in part) / len(part)
            best = margin if best is None else max(best, margin)
        want = 1 / (1 + np.exp(-(model.bias + (model.scale * best if words else 0))))
        assert got == pytest.approx(want, abs=1e-4)


def test_few_labels_teach_enough():
    rows, marks = insulting(320, seed=3)
    fresh, truth = insulting(300, seed=4)
    model = toxicity.train([toxicity.words_of(x) for _, x in rows], np.array([t for *_, t in marks], dtype=np.float32))
    found = toxicity.Scorer(model).scores([x for _, x in fresh]) >= 0.5
    toxic = np.array([t for *_, t in truth]) == 1
    assert found[toxic].mean() > 0.9 and found[~toxic].mean() < 0.05


def test_toxicity_of_odd_documents(spark):
    got = toxicity.toxicity(odd_docs(spark), labels(spark, [(1, 1, 0), (5, 0, 1), (5, 0, 0), (7, None, None)])).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(odd_docs(spark), labels(spark)).count() == len(ROWS)
    assert toxicity.toxicity(no_docs(spark), labels(spark)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 5), (1000, 1200), (3000, 2**40), (5000, 2**63), (200, 2**64 - 1)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        seq = ngram.EliasFano(v)
        place = {x: i for i, x in enumerate(v.tolist())}
        asked = np.concatenate([v, rng.integers(0, top, 300, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64)])
        assert seq.find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
        if len(v):
            assert (seq[np.arange(len(v))] == v).all()


def brute_scores(rows):
    uni, bi, texts = Counter(), Counter(), []
    for i, x in rows:
        w = [*(x or "").encode().lower().split(), None]
        texts.append((i, w))
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            uni.update(w)
            bi.update(zip(w, w[1:]))
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    for i, w in texts:
        base = sum(math.log10(p(x)) for x in w)
        score = math.log10(p(w[0])) + sum(math.log10((bi[a, b] + ngram.MU * p(b)) / (uni[a] + ngram.MU)) for a, b in zip(w, w[1:]))
        yield i, len(w), sum(uni[x] > 0 for x in w), n, base, score


@pytest.mark.parametrize("block", [60, 4_000_000])
def test_scores_against_brute_force(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(ngram, "BLOCK_TOKENS", block)
    docs = read_table(spark, sf_dir, "documents").filter("doc_id < 40").select("doc_id", "text").union(odd_docs(spark).selectExpr("doc_id + 1000", "text"))
    got = sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram.scores(docs).collect())
    want = sorted((r[0] is not None, *r) for r in brute_scores([tuple(r) for r in docs.collect()]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=2e-4 * w[2])
    assert ngram.scores(no_docs(spark)).count() == 0


def test_mixing_meets_targets(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = mixing.mixed(docs, read_table(spark, sf_dir, "labels"), ["doc_id"], {"clean": 0.8, "low": 0.2}).toPandas()
    total = got.n_tokens.sum()
    for d, share in (("clean", 0.8), ("low", 0.2)):
        assert (got.n_tokens * got.rate * got[f"p_{d}"]).sum() / total == pytest.approx(share, abs=1e-3)
    assert (got.rate >= 0).all() and ((got.copies - got.rate).abs() < 1).all()
    assert np.allclose(got.p_clean + got.p_low, 1)
    # the same descent, in numpy
    p, tokens = got[["p_clean", "p_low"]].to_numpy(), got.n_tokens.to_numpy(dtype=float)
    wanted, rate = total * np.array([0.8, 0.2]), np.ones(len(got))
    for _ in range(mixing.STEPS):
        gap = (tokens * rate) @ p - wanted
        if abs(gap).max() <= mixing.TOLERANCE * total:
            break
        rate = np.maximum(0, rate - p @ np.linalg.solve((p.T * tokens) @ p, gap))
    assert np.allclose(rate, got.rate, atol=1e-6)


def test_mixing_of_odd_documents(spark):
    got = mixing.mixed(odd_docs(spark), labels(spark, [(1, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, 1)]), ["doc_id", "rate", "n_tokens"], names={"rate": "r", "n_tokens": "t"}).collect()
    assert len(got) == len(ROWS) and {r.t for r in got if r.doc_id in (2, 3, 4)} == {0} and all(r.rate == 1 for r in got)
    assert mixing.mixed(odd_docs(spark), labels(spark), ["doc_id"]).count() == len(ROWS)
    assert mixing.mixed(no_docs(spark), labels(spark), ["doc_id"]).count() == 0


def test_native_plan(spark, sf_dir):
    plan = mixing.mixed(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://WWW.Example.com/en/1?x=/fr/", "www.example.com", "/en/1", ("www.example.com/en/", "allow")),
        ("https://m.example.com/en/", "m.example.com", "/en/", ("example.com/en/", "block")),
        ("x://example.com", "example.com", "", None),
        ("x://com/a#b", "com", "/a", ("com/", "allow")),
        ("x://telecom/a", "telecom", "/a", None),
        ("x://a.net/es/?q", "a.net", "/es/", ("net/es/", "block")),
        ("x://a.net/ES/", "a.net", "/ES/", None),
        ("x://?a", "", "", None),
        ("no host", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
    ],
)
def test_rules(url, host, path, rule):
    assert urls.split_url(url) == (host, path)
    assert urls.Rules(urls.RULES).match(host, path) == rule


def test_segmentation_is_the_likeliest():
    counts = {"spam": 5, "farm": 5, "far": 9, "m": 2, "sp": 3, "am": 8, "best": 4}
    seg = urls.Segmenter(counts)

    def every(name):
        if not name:
            yield []
        for i in range(1, len(name) + 1):
            for rest in every(name[i:]):
                yield [name[:i], *rest]

    def cost(parts):
        return sum(seg.cost.get(w, seg.strange + math.log(10) * len(w)) for w in parts)

    for name in ("spamfarm", "bestam", "xspam", "qqqq", ""):
        best = min(map(cost, every(name)))
        assert any([w if w in counts else urls.UNKNOWN for w in parts] == seg.words(name) for parts in every(name) if cost(parts) <= best + 1e-9)


def test_url_query_against_brute_force(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html").union(spark.createDataFrame([(-1, None, None), (-2, "", ""), (-3, "x://q.org/a", None), (-3, "x://q.org/a", None)], "page_id long, url string, html string"))
    rows = pages.collect()
    lexicon = Counter(w for r in rows if r.html for w in urls.WORD.findall(urls.TAG.sub(" ", r.html).lower()) if len(w) <= urls.MAX_WORD)
    seg, book, seen = urls.Segmenter(dict(lexicon)), urls.Rules(urls.RULES), Counter()
    for r in rows:
        host, path = urls.split_url(r.url)
        if hit := book.match(host, path):
            seen.update((hit[1], t) for t in ["", *seg.tokens(host, path)])
    block = {t: n for (v, t), n in seen.items() if v == "block"}
    allow = {t: n for (v, t), n in seen.items() if v == "allow"}
    size = len((set(block) | set(allow)) - {""}) + 1
    odds = lambda t: math.log((block.get(t, 0) + 1) / (sum(block.values()) - block[""] + size)) - math.log((allow.get(t, 0) + 1) / (sum(allow.values()) - allow[""] + size))
    want = []
    for r in rows:
        host, path = urls.split_url(r.url)
        hit = book.match(host, path)
        score = math.log((block[""] + 0.5) / (allow[""] + 0.5)) + sum(odds(t) for t in seg.tokens(host, path))
        want.append((r.page_id, host, path, hit[0] if hit else None, hit[1] if hit else "block" if score > 0 else "allow"))
    got = [tuple(r) for r in urls.judged(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.verdict for r in urls.judged(pages, rules=[]).collect()} == {"allow"}
    assert urls.judged(pages.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [2, 1024])
def test_least_count_of_the_lexicon(spark, monkeypatch, ranges):
    monkeypatch.setattr(urls, "RANGES", ranges)
    counts = [1] * 7 + [2] * 3 + [5, 5, 90, 4000, 10**12]
    df = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(counts)], "w string, n long")
    for size in range(len(counts) + 2):
        least = urls.least_count(df, size)
        assert sum(n >= least for n in counts) <= size and (least == 1 or sum(n >= least - 1 for n in counts) > size)
    assert urls.least_count(df.limit(0), 3) == 1


def test_lexicon_keeps_words_of_one_count_together(spark):
    pages = spark.createDataFrame([("<p>a a a b b c c</p> d",), (None,), ("",)], "html string")
    assert urls.lexicon_of(pages, "html", 4) == {"a": 3, "b": 2, "c": 2, "d": 1}
    assert urls.lexicon_of(pages, "html", 2) == {"a": 3}
    assert urls.lexicon_of(pages.limit(0), "html", 2) == {}


def test_mixing_learns_from_few_labels(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(["good prose here", "good prose there", "vile vile words", "vile vile text"])], "doc_id long, text string")
    got = mixing.mixed(docs, labels(spark, [(0, 1, 0), (2, 0, 1)]), ["doc_id"], {"clean": 0.5, "toxic": 0.5}).orderBy("doc_id").collect()
    assert got[1].p_clean > 0.5 > got[1].p_toxic and got[3].p_toxic > 0.5 > got[3].p_clean


def test_mixing_says_when_totals_miss_their_targets(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 0)
    docs = read_table(spark, sf_dir, "documents")
    with pytest.warns(UserWarning, match="after 0 steps"):
        assert mixing.mixed(docs, read_table(spark, sf_dir, "labels"), ["doc_id"], {"clean": 0.8, "low": 0.2}).count() == docs.count()


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", toxicity.in_fold("doc_id").alias("f"))
    assert all(r.f == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5) for r in df.collect())
    assert df.filter(F.col("f") != 0).count() < 50


def test_large_ids_beside_null_ids(spark):
    """Beyond 2**53 ids are not whole as floating-point numbers."""
    ids = [(1 << 53) + 1, None, -(1 << 63), (1 << 63) - 1, None]
    got = ngram.scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, ids))
