"""Merkle manifests against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodefinder.llm import merkle
from tests.llm.helpers import no_docs, odd_docs

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    steps = []
    for nodes in levels[:-1]:
        at = i // 8 * 8
        steps.append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + 8])))
        i //= 8
    return steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[g] = levels_of([leaf(r, r["text"]) for r in groups[g]])
    top, out = levels_of([trees[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps, true = path(trees[g], i) + path(top, k), leaf(r, r["text"])
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            found = leaf(r, r["text"].translate(str.maketrans(merkle.UPPER, merkle.LOWER))) if hit and r["text"] is not None else true
            for a, b in steps:
                found = digest(a + found + b)
            out.append((r["doc_id"], true, trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), found, found == top[-1][0]))
    return sorted(map(repr, out))


def shown(df):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize(("sizes", "part_rows"), [({"b": 1}, 9), ({None: 3, "a": 8, "é": 9, "z" * 40: 65}, 7), ({"hot": 530, "a": 1}, 30)])
def test_manifest_equals_brute_force(spark, monkeypatch, sizes, part_rows):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    rng, rows = random.Random(3), []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append({"doc_id": rng.choice([None, -5, *range(400)]), "text": rng.choice([None, "", "Ab C", "é" * 30, "plain"]), "lang": lang, "source": rng.choice([None, "", "s"]), "n_chars": rng.choice([None, 7])})
    rows += rows[:3]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert shown(merkle.verified_manifest(df.repartition(3))) == brute(rows)


def test_manifest_of_odd_documents(spark):
    docs = odd_docs(spark, n_chars="3L", leaf="'x'", root="'x'", g="1", o="2", hash="'h'")
    assert shown(merkle.verified_manifest(docs)) == brute([r.asDict() for r in docs.collect()])
    empty = merkle.verified_manifest(no_docs(spark).withColumn("n_chars", F.lit(1)))
    assert empty.count() == 0 and empty.columns == COLUMNS


def test_proofs_fold_to_the_root(spark):
    docs = odd_docs(spark, n_chars="3L")
    made = merkle.manifest(docs, "doc_id", "source", ["doc_id", "text"], kept=F.col("lang"))
    assert made.columns == ["doc_id", "kept", "leaf", "subroot", "root", "proof"]
    assert made.filter(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == docs.count() == made.filter("kept = 'en'").count()
