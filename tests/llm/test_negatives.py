"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefinder.llm import negatives, queries
from tests.compare import connect, duck_rows, spark_rows

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors):
    """rows of (id, whole vector, label)."""
    rows, out = sorted(set(rows)), set()
    firsts = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if anchors(r[0]):
            firsts.setdefault(r[0], r)
    for a in firsts.values():
        score = lambda r: sum(x * y for x, y in zip(a[1], r[1]))  # noqa: B023, E731
        met = [r for r in rows if len(r[1]) == len(a[1])]
        near = sorted((r for r in met if r[2] == a[2] and r[0] != a[0]), key=lambda r: (-score(r), r[0]))[:5]
        for p in near:
            hard = sorted((r for r in met if r[2] != a[2] and 80 * score(p) <= 100 * score(r) <= 100 * score(p)), key=lambda r: (-score(r), r[0]))[:5]
            out |= {(a[0], p[0], k, r[0], score(p), score(r)) for k, r in enumerate(hard, 1)}
    return out


def mined(spark, rows, scale=256):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "row", "slot", "score", "dim")})
    return negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 3 == 0, scale=scale)


@pytest.mark.parametrize("values", [[-1.0, 0.0, 1.0], None])
@pytest.mark.parametrize("file_rows", [16, 8192])
def test_equals_brute_force(spark, monkeypatch, values, file_rows):
    """Few values: ties and copies everywhere. Many: cells hold several components."""
    monkeypatch.setattr(negatives, "FILE_ROWS", file_rows)
    monkeypatch.setattr(negatives, "CELLS", 256 if values else 7)
    rng = random.Random(7)
    rows = [(i, [rng.choice(values) if values else float(np.float32(rng.gauss(0, 1))) for _ in range(3 if i % 9 else 2)], rng.randint(0, 3)) for i in range(160)]
    rows += [(1000 + i, rows[1][1], 1 + (i == 3)) for i in range(40)] + rows[:5]
    want = brute([(i, tuple(int(np.floor(256 * x)) for x in v), label) for i, v, label in rows], lambda i: i % 3 == 0)
    assert {tuple(r[c] for c in COLUMNS) for r in mined(spark, rows).collect()} == want and want


def test_odd_rows_take_no_part(spark):
    odd = [(None, [1.0], 1), (1, None, 1), (2, [], 1), (3, [float("nan")], 1), (4, [float("inf")], 1), (5, [None], 1), (6, [1.0], None)]
    assert mined(spark, odd).count() == 0 and mined(spark, []).columns == COLUMNS and mined(spark, []).count() == 0
    assert [tuple(r) for r in mined(spark, [*odd, (9, [1.0], 1), (10, [2.0], 1), (11, [1.75], 2)], scale=10).collect()] == [(9, 10, 1, 11, 200, 170)]


def test_query_equals_sql(spark, sf_dir):
    columns, rows = spark_rows(queries.op13_hard_negatives(spark, sf_dir))
    assert (columns, rows) == duck_rows(connect(sf_dir), negatives.ORACLE) and rows
