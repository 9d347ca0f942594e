"""Near-duplicates, top-k, quality rules, the pipeline and the registered queries."""

from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodefinder.llm import dedup, quality, topk
from lodefinder.llm import queries as registered
from lodefinder.llm.common import read_table, work_dir
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.helpers import ROWS, no_docs, odd_docs


def brute_groups(rows):
    sets, parent = {}, {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets.setdefault(i, set()).update(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w)
        parent[i] = i
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter((a, b) for v in holders.values() for a in v for b in v if a < b)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(seed=0):
    """Chains and large groups of near copies of random texts, some too different to be linked."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for group in (1, 2, 5, 80, 3):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(group):
            copy = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 7))):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
            if rng.random() < 0.3:
                base = copy
    shared = [f"s{x}" for x in range(60)]  # a passage that many texts share
    for _ in range(60):
        rows.append((n, " ".join([*shared, *(f"y{x}" for x in rng.integers(0, 10**6, 60))])))
        n += 1
    return rows


@pytest.mark.parametrize(("block", "shingles", "rounds"), [(1024, 1 << 19, 1), (7, 1 << 19, 0), (1024, 500, 0)])
def test_groups_against_brute_force(spark, monkeypatch, block, shingles, rounds):
    """Whether pivots or blocks of mixed buckets find the links, and however small the blocks are."""
    for name, value in {"BLOCK": block, "BLOCK_SHINGLES": shingles, "PIVOT_ROUNDS": rounds}.items():
        monkeypatch.setattr(dedup, name, value)
    rows = near_copies()
    want, sizes = brute_groups(rows)
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_edited_copies(spark):
    """Copies with many edits: of the pairs some are links and most are not, in buckets that all of them share."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{x}" for x in range(150)], []
    for i in range(400):
        copy = list(base)
        for at in rng.integers(0, 150, int(rng.integers(3, 9))):
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy)))
    want, _ = brute_groups(rows)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 1 < len(set(want.values())) < 400


@pytest.mark.parametrize("exact", [True, False])
def test_links_of_a_block_are_a_forest(exact):
    """Sixty groups of one row that all link with one another, and five that link with nothing: 59 links, not 1,770."""
    rows, rng = 65, np.random.default_rng(2)
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(i % 10 if i < 60 else 1000 * i) for i in range(rows)]
    got = {"rep": np.arange(rows), "component": np.arange(rows), "n": np.full(rows, 100), "rest": np.arange(rows) > 0, "first": 100 * np.arange(rows)}
    got |= {"slots": np.array([np.zeros(250) if i < 60 else rng.integers(1, 255, 250) for i in range(rows)], dtype=np.uint8), "bands": np.full((rows, 50), 7)}
    got["bits"] = dedup.bits_of(got["slots"]).view(np.uint64)
    flat = {"flat": np.concatenate(sets)} if exact else {}
    found = dedup.links_in_block({k: v[1:] for k, v in got.items()} | flat, got | flat, 7, 75)
    group = list(range(rows))
    for a, b in found:
        group = [group[b] if g == group[a] else g for g in group]
    assert len(found) == 59 and len(set(group[:60])) == 1 and len(set(group)) == 6


@pytest.mark.parametrize("rounds", [1, 0])
def test_every_text_of_a_repeated_id_has_its_links(spark, monkeypatch, rounds):
    monkeypatch.setattr(dedup, "PIVOT_ROUNDS", rounds)
    rng = np.random.default_rng(3)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 120)] for _ in range(9)]
    near = lambda k, i: " ".join([*texts[k][:-1], f"x{k}y{i}"])
    rows = [(i, near(i + k, i)) for i in range(8) for k in range(2)]  # each id has a text near one of the next id
    rows += [(0, near(0, 0))] * 3 + [(20, near(0, 20)), (21, near(8, 21)), (22, "a text without links")]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict.fromkeys([*range(8), 20, 21], 0) | {22: 22} and len(got) == len(rows)


def test_groups_of_odd_documents(spark):
    got = dedup.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (2, 3, 4)) and by[7].kept and by[None].component_id is None
    assert dedup.near_duplicates(no_docs(spark)).count() == 0


def test_signatures():
    rng = np.random.default_rng(1)
    single = dedup.super_minhash([np.array([5], dtype=np.uint64)])[0]
    assert sorted((single >> 24).tolist()) == list(range(250))  # one element: a permutation, level by level
    for share in (0.5, 0.75, 0.9):
        found = []
        for _ in range(20):
            common = int(800 * share / (1 + share))
            both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (common, 400 - common, 400 - common))
            x, y = dedup.super_minhash([np.concatenate([both, a]), np.concatenate([both, b])])
            found.append((x == y).mean())
        assert np.mean(found) == pytest.approx(share, abs=0.02)


@pytest.mark.parametrize("limit", [dedup.EDGES, 20])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(dedup, "EDGES", limit)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(90)]
    rows += [(90, None), (91, [1.0, None] * 4), (92, [float("nan")] * 8), (93, [float("inf")] * 8), (94, []), (95, rows[3][1]), (40, rows[40][1]), (None, rows[0][1]), (97, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1))
    good = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in range(0, 90, 20):
        vector = dict(good)[q]
        best = sorted((-int(vector @ v), i) for i, v in good if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("fan", [2, 16])
def test_top_k_in_many_tiles(spark, monkeypatch, fan):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "FAN", fan)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    vectors = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    want = [(q, r + 1, i, -s) for q in range(0, 300, 20) for r, (s, i) in enumerate(sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()) == sorted(want)


def test_large_products_are_exact():
    q, c = np.array([[2**40, 3]]), np.array([[2**20, 1], [-(2**22), 5]])
    assert topk.product(q, c).tolist() == [[2**60 + 3, -(2**62) + 15]]


@pytest.mark.parametrize(
    ("value", "want"),
    [(None, (0, 0, 0, 0, 0)), ("a b c a b c", (6, 6, 0, 0, 6)), ("x\nx\n\n\ny|\nx", (4, 5, 1, 2, 0)), ("a a a a", (4, 4, 0, 0, 4)), (" \n ", (0, 0, 0, 0, 0)), ("a b c d a b c", (7, 7, 0, 0, 6))],
)
def test_base_rules(value, want):
    assert quality.base_of(value) == want


def test_depleted_documents_go(spark):
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731  digits are all one to a normalised line
    menu = " ".join(f"menu{letters(k)}" for k in range(60))
    own = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(60))
    rows = [(i, f"{menu}\n{own(i)}\n tail {letters(i)}", "a") for i in range(30)]  # boilerplate, but enough of their own
    rows += [(100 + i, f"{menu}\nonly {own(i)[:20]}", "a") for i in range(30)]  # little but boilerplate
    rows += [(200 + i, f"copied {own(999)}\n{own(998)}", "a") for i in range(30)]  # copies of one text are no boilerplate
    rows += [(100, rows[30][1], "a")] * 3  # repeated rows count their words once
    rows += [(300, f"{menu}\nonly this", "b")]  # elsewhere the line is not frequent
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(30)) and all(got[200 + i].kept for i in range(30)) and got[300].n_line_words == 0
    assert not any(got[100 + i].kept for i in range(30)) and not got[100].base_failed and got[100].n_line_words == 60


def test_edited_copies_are_no_boilerplate(spark):
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    text = [[f"w{letters(j)}x{letters(k)}" for k in range(20)] for j in range(12)]
    rows = []
    for i in range(300):  # one word replaced in each copy, so all sets of lines differ
        copy = [list(line) for line in text]
        copy[i % 12][(i // 12) % 20] = f"edit{letters(i)}"
        rows.append((i, "\n".join(map(" ".join, copy)), "a"))
    got = quality.quality(spark.createDataFrame(rows * 2, "doc_id long, text string, source string"), ["doc_id"]).collect()
    assert len(got) == 600 and all(r.kept and r.n_line_words == 0 for r in got)


def test_boilerplate_does_not_depend_on_the_size_of_a_source(spark):
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    menu = " ".join(f"menu{letters(k)}" for k in range(30))
    rows = [(i, f"{menu}\n" + " ".join(f"w{letters(i)}x{letters(k)}" for k in range(60)), "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rest = spark.range(1000, 32_000).selectExpr("id AS doc_id", "string(NULL) AS text", "'a' AS source")
    got = quality.quality(docs.union(rest), ["doc_id"]).filter("doc_id < 30").collect()
    assert [r.n_line_words for r in got] == [30] * 30


def test_equal_lines_and_near_copies_are_one_class(spark):
    words = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(0, words + " one", 1), (1, words + " two", 2), (2, "other words", 2), (3, "text of its own", 4)] * 2  # 0 and 1 are near, 1 and 2 have one content
    sketched = [(key, content, n[0], b[0].tolist(), s[0]) for key, text, content in rows for n, b, s in [dedup.sketch_of([text])]]
    got = {tuple(r) for r in quality.copies_of(spark.createDataFrame(sketched, "text_key long, content long, n long, bands array<long>, slots binary")).collect()}
    assert got == {(0, 0), (1, 0), (2, 0)}  # 3 has no link


def test_sketches_group_as_full_sets_do(spark):
    rows = near_copies(3)
    n, bands, slots = dedup.sketch_of([x for _, x in rows])
    sketched = spark.createDataFrame([(i, a, list(map(int, b)), c) for (i, _), a, b, c in zip(rows, n, bands, slots, strict=True)], "id long, n long, bands array<long>, slots binary")
    none = spark.createDataFrame([], "a long, b long")
    got = {r.node: r.component for r in dedup.sketch_groups(sketched, none).collect()}
    want, _ = brute_groups(rows)
    assert len({got.get(i, i) for i in want}) <= 1.5 * len(set(want.values()))
    same = [(i, j) for i in want for j in want if i < j and got.get(i, i) == got.get(j, j)]
    base = {i: x.split() for i, x in rows}
    assert same and all(sum(p == q for p, q in zip(base[i], base[j])) > 60 for i, j in same)  # nothing of another text


def test_quality_of_odd_documents(spark):
    got = quality.quality(odd_docs(spark), ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(r.base_failed and not r.kept for r in got)
    assert quality.quality(no_docs(spark), ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert spark_rows(registered.queries()[name](spark, sf_dir)) == duck_rows(connect(sf_dir), registered.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(registered.oracle_sql())))
def test_whole_tables(spark, sf_dir, name):
    table = "pages" if name.startswith("op9") else "documents"
    assert registered.queries()[name](spark, sf_dir).count() == read_table(spark, sf_dir, table).count()


def test_pipeline_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf_dir)
        if name != "sentencepiece":
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near-duplicates":
            want, _ = brute_groups([tuple(r) for r in before.select("doc_id", "text").collect()])
            assert ids == {i for i, c in want.items() if i == c}
        if name == "mixing":
            assert len({r.doc_id for r in before.select("doc_id").collect()} - ids) < 0.2 * before.count()
    assert docs.filter("NOT round_trip").count() == 0


def test_pipeline_of_odd_documents(spark, sf_dir):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        assert stage(spark, no_docs(spark), sf_dir).count() == 0
        out.count()


def test_rounds_leave_no_tables_behind(spark, sf_dir):
    """What is left of a run is what its result reads: the sketches and the last groups; and the result can be read twice."""
    place = Path(urlparse(work_dir(spark)).path)
    before = set(place.iterdir())
    got = dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    first = sorted(got.collect())
    left = sorted(p.name.rpartition("-")[0] for p in set(place.iterdir()) - before if any(p.glob("part-*")))
    assert set(left) <= {"sketches", "links", "members"} and left.count("sketches") == 1
    assert sorted(got.collect()) == first
