"""Catalog search against BM25 over all pairs, in plain Python."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodefinder.operators import catalog_index
from lodefinder.plans.queries import bm25
from tests.compare import duck_rows, spark_rows


def brute(queries, docs, n):
    docs = {i: t.split() for i, t in docs if t and t.split()}
    if not docs:
        return set()
    mean, df = sum(map(len, docs.values())) / len(docs), {}
    for w in docs.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = set()
    for q in queries:
        scores = {}
        for i, w in docs.items():
            parts = [math.log(1 + (len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(q.split()) if x in w]
            if parts:
                scores[i] = round(math.fsum(parts), 9)
        out |= {(q, i, rank) for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:n], 1)}
    return out


@pytest.mark.parametrize(("words", "n_docs", "n"), [("abcdefghijklmnopqrstuvwxyz", 200, 10), ("aaaaaaaabbbbccd", 120, 10), ("ab", 30, 3)])
def test_best_documents(spark, words, n_docs, n):
    rng = random.Random(len(words))
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(n_docs)] + [(9999, None)]
    queries = sorted({" ".join(sorted(rng.choices(words + "?", k=rng.randint(1, 5)))).replace("?", "unknown") for _ in range(40)} | {""})
    index = catalog_index.index_of(spark.createDataFrame(docs, "doc long, text string"), "doc", F.col("text"))
    got = catalog_index.best_documents(spark.createDataFrame([(q,) for q in queries], "q string"), index, n)
    assert {(r.q, r.doc, r.rank) for r in got.collect()} == brute(queries, docs, n)


def test_frequent_words_bring_no_candidates(spark):
    """A word that all releases share is not needed where a rarer one tells enough of them apart."""
    docs = spark.createDataFrame([(i, f"brand {'rare' if i % 10 == 0 else 'other'} x{i}") for i in range(200)], "doc long, text string")
    index = catalog_index.index_of(docs, "doc", F.col("text"))
    terms = catalog_index.needed_terms(spark.createDataFrame([("brand rare",)], "q string"), index, 10)
    assert {r.term: r.needed for r in terms.collect()} == {"rare": True, "brand": False}
    empty = catalog_index.index_of(docs.limit(0), "doc", F.col("text"))
    assert catalog_index.best_documents(spark.createDataFrame([("brand",)], "q string"), empty).count() == 0


def test_alike_documents_are_one_class(spark):
    """A word that all documents share, and no other tells apart, brings a class of n documents, not all of them."""
    docs = spark.createDataFrame([(i, f"brand x{i}" if i % 2 else f"brand brand x{i}") for i in range(2000)], "doc long, text string")
    index = catalog_index.index_of(docs, "doc", F.col("text"))
    queries = spark.createDataFrame([("brand",), ("brand absent",)], "q string")
    classes = catalog_index.classes_of(catalog_index.needed_terms(queries, index, 5), index, 5).collect()
    assert sorted(sorted(d.doc for d in c.docs) for c in classes) == [[0, 2, 4, 6, 8], [1, 3, 5, 7, 9]]
    got = catalog_index.best_documents(queries, index, 7).collect()
    assert {(r.q, r.doc, r.rank) for r in got} == {(q, 2 * i, i + 1) for q in ("brand", "brand absent") for i in range(7)}


def test_odd_ids_as_in_sql(spark, monkeypatch):
    """Ids that are null or repeat, texts that are alike, more tasks than one and many files."""
    monkeypatch.setattr(catalog_index, "WORDS_A_TASK", 40)
    monkeypatch.setattr(catalog_index, "ROWS_A_FILE", 7)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)] if i % 3 == 0 else range(100, 160)), " ".join(rng.choices("aaabbcde", k=rng.randint(0, 4)))) for i in range(150)]
    asked = [("a",), ("a b",), ("c d a",), ("e zz",), ("zz",)]
    frame, queries = spark.createDataFrame(rows, "doc long, shown string"), spark.createDataFrame(asked, "q string")
    index = catalog_index.index_of(frame, "doc", F.col("shown"))
    assert index.tasks > 3
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc BIGINT, shown VARCHAR); CREATE TABLE a (q VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", rows)
    con.executemany("INSERT INTO a VALUES (?)", asked)
    for n in (3, 20):
        want = duck_rows(con, f"WITH {bm25('SELECT * FROM d', 'SELECT q FROM a', n)} SELECT q, doc, rank, score FROM ranked")
        assert spark_rows(catalog_index.best_documents(queries, index, n).select("q", "doc", "rank", "score")) == want


@pytest.mark.parametrize(("shown", "names"), [("A - T", ("A", "T")), ("A - T - x", ("A", "T")), (" Only ", ("Only", "Only")), ("", ("", "")), (None, ("", ""))])
def test_release_names(spark, shown, names):
    artist, title = catalog_index.release_names(F.col("s"))
    assert tuple(spark.createDataFrame([(shown,)], "s string").select(artist.alias("a"), title.alias("t")).first()) == names
