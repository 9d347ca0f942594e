"""Hard negatives by a vector-approximation file: bounds from quantised vectors first, exact scores for what is left.

Each dimension is cut into 256 cells; a row's approximation is one byte for each dimension, kept in blocks of rows
apart from the exact vectors. For a block of anchors, tables of the cells' least and largest components turn the bytes
of a block into bounds that hold for every score. An anchor's n-th largest lower bound among rows that surely belong to
a window is a threshold: rows whose upper bound falls short of it can not be among the window's first n. Only the
others meet their exact vectors, in a join by row. The positives are the window without a top; once their scores are
known, each of them opens a window of its own for the negatives.

Of rows with one label and one vector only the WANTED + 1 smallest identifiers can matter (one may be the anchor's own),
so that groups of copies shrink, exactly, before anything meets them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodefinder.llm.common import staged
from lodefinder.llm.topk import product, usable

#: Cells of a dimension (a byte), rows of a block of approximations, anchors that meet a block at once, standard
#: deviations from the mean that inner cells cover, and how many positives and negatives are wanted.
CELLS, FILE_ROWS, ANCHOR_ROWS, SPREAD, WANTED = 256, 8192, 256, 4.0, 5
#: Percent of the positive's score from which a negative counts as hard.
LOW_PERCENT = 80
LEAST = np.iinfo(np.int64).min


def cell_bounds(low: int, high: int, mean: float, deviation: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component of each cell: even steps around the mean, the outer cells open to the extremes."""
    a = min(max(int(np.floor(mean - SPREAD * deviation)), low), high)
    b = max(min(int(np.ceil(mean + SPREAD * deviation)), high), a)
    least = np.array([low] + [a + (b - a + 1) * k // CELLS for k in range(1, CELLS)], dtype=np.int64)
    return least, np.append(least[1:] - 1, high)


def cells_of(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the bounds of its cells (dimension x cell): one small row for each dimension."""
    each = rows.select("dim", F.posexplode("v").alias("pos", "x"))
    stats = each.groupBy("dim", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    found: dict[int, list] = {}
    for r in sorted(stats.collect()):
        found.setdefault(r.dim, []).append(cell_bounds(r.low, r.high, r.mean, r.deviation))
    return {dim: (np.array([x[0] for x in made]), np.array([x[1] for x in made])) for dim, made in found.items()}


def matrices(batches: Iterator[pa.RecordBatch], size: int, numbers: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of numbers and the vectors (column v) of at most size rows of one length at a time."""
    held: dict[int, list] = {}
    count: dict[int, int] = {}

    def close(dim: int):
        parts = held.pop(dim)
        count.pop(dim)
        return {c: np.concatenate([p[0][c] for p in parts]) for c in numbers}, np.concatenate([p[1] for p in parts])

    for batch in batches:
        table = batch.select([*numbers])
        columns = {c: table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in numbers}
        v = batch.column("v")
        ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(ends)
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            for i in range(0, len(at), size):
                some = at[i : i + size]
                held.setdefault(int(dim), []).append(({c: x[some] for c, x in columns.items()}, flat[ends[some][:, None] + np.arange(dim)]))
                count[int(dim)] = count.get(int(dim), 0) + len(some)
                if count[int(dim)] >= size:
                    yield close(int(dim))
    for dim in list(held):
        yield close(dim)


def record(values: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)


def approximated(rows: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The file: blocks of (row numbers, ids, labels) and one byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for made, (columns, v) in enumerate(matrices(batches, FILE_ROWS, ["row", "id", "label"])):
            least, _ = cells[v.shape[1]]
            codes = np.stack([np.searchsorted(least[d], v[:, d], side="right") - 1 for d in range(v.shape[1])], axis=1).astype(np.uint8)
            values = [(part << 32) + made, v.shape[1], *(columns[c].tobytes() for c in ("row", "id", "label")), codes.tobytes()]
            yield record(values, [pa.int64(), pa.int32()] + [pa.binary()] * 4, ["block", "dim", "row", "id", "label", "codes"])

    return rows.select("row", "id", "label", "v").mapInArrow(run, "block long, dim int, row binary, id binary, label binary, codes binary")


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Blocks of anchors: ids, labels, vectors, and the scores that their windows start at (LEAST where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for made, (columns, v) in enumerate(matrices(batches, ANCHOR_ROWS, ["id", "label", *(f"top{j}" for j in range(WANTED))])):
            tops = np.stack([columns[f"top{j}"] for j in range(WANTED)], axis=1)
            values = [(part << 32) + made, v.shape[1], columns["id"].tobytes(), columns["label"].tobytes(), v.astype(np.int64).tobytes(), tops.tobytes()]
            yield record(values, [pa.int64(), pa.int32()] + [pa.binary()] * 4, ["a_block", "dim", "a_id", "a_label", "a_v", "tops"])

    columns = ["id", "label", *(F.coalesce(F.try_element_at("tops", F.lit(j + 1)), F.lit(LEAST)).alias(f"top{j}") for j in range(WANTED)), "v"]
    return anchors.select(*columns).mapInArrow(run, "a_block long, dim int, a_id binary, a_label binary, a_v binary, tops binary")


def best_of(group: np.ndarray, score: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Places of each group's n highest scores, ties to the smaller key, group by group."""
    order = np.lexsort((key, -score, group))
    group = group[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return order[place < n]


def survivors(blocks: DataFrame, file: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray]], negatives: bool) -> DataFrame:
    """(anchor, slot, row, id, low, high, sure): what one block alone can not rule out for an anchor's window.

    Positives have one window, slot 0, of rows with the anchor's label and another id, that is open to the top.
    Negatives have one for each positive: rows of other labels from LOW_PERCENT of its score up to the score. sure says
    that a row is not above the window's top by any value within its bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                whole = {c: np.frombuffer(r[c], dtype=np.int64) for c in ("row", "id", "label", "a_id", "a_label")}
                n, m, dim = len(whole["row"]), len(whole["a_id"]), r["dim"]
                a = np.frombuffer(r["a_v"], dtype=np.int64).reshape(m, dim)
                tops = np.frombuffer(r["tops"], dtype=np.int64).reshape(m, WANTED)
                codes, (least, largest) = np.frombuffer(r["codes"], dtype=np.uint8).reshape(n, dim), cells[dim]
                d = np.arange(dim)
                low_of, high_of = least[d, codes], largest[d, codes]  # the tables' bounds of each component
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                low = product(up, low_of) + product(down, high_of)
                high = product(up, high_of) + product(down, low_of)
                same = whole["a_label"][:, None] == whole["label"][None, :]
                if negatives:
                    there = tops != LEAST
                    top = np.where(there, tops, LEAST).max(axis=1)
                    floor = np.where(there, -(-LOW_PERCENT * tops // 100), np.iinfo(np.int64).max).min(axis=1)
                    at_a, at_r = np.nonzero(~same & (low <= top[:, None]) & (high >= floor[:, None]))
                    windows = [(tops[:, j], -(-LOW_PERCENT * tops[:, j] // 100), there[:, j]) for j in range(WANTED)]
                else:
                    ok = same & (whole["a_id"][:, None] != whole["id"][None, :])
                    if n > WANTED:  # what is below the threshold goes before it is listed
                        cut = np.partition(np.where(ok, low, LEAST), n - WANTED, axis=1)[:, n - WANTED]
                        ok &= high >= cut[:, None]
                    at_a, at_r = np.nonzero(ok)
                    windows = [(np.full(m, np.iinfo(np.int64).max), np.full(m, LEAST), np.full(m, True))]
                lo, hi, key = low[at_a, at_r], high[at_a, at_r], whole["id"][at_r]
                for slot, (top, floor, there) in enumerate(windows):
                    inside = np.flatnonzero(there[at_a] & (lo <= top[at_a]) & (hi >= floor[at_a]))
                    sure = hi[inside] <= top[at_a[inside]]
                    certain = inside[sure]
                    best = certain[best_of(at_a[certain], lo[certain], key[certain], WANTED)]
                    # the n-th best that is sure, where there are n: score and id
                    anchor = at_a[best]
                    count = np.bincount(anchor, minlength=m)
                    full, last = count == WANTED, np.cumsum(count) - 1
                    t_low = np.where(full, lo[best][last] if len(best) else 0, LEAST)
                    t_key = np.where(full, key[best][last] if len(best) else 0, np.iinfo(np.int64).max)
                    of = at_a[inside]
                    left = (hi[inside] > t_low[of]) | ((hi[inside] == t_low[of]) & (key[inside] <= t_key[of]))
                    out, sure = inside[left], sure[left]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(whole["a_id"][at_a[out]]), pa.array(np.full(len(out), slot, dtype=np.int32)), pa.array(whole["row"][at_r[out]]), pa.array(key[out]), pa.array(lo[out]), pa.array(hi[out]), pa.array(sure)],
                        names=["anchor", "slot", "row", "id", "low", "high", "sure"],
                    )

    # each block of the file gets the number of each block of anchors; the blocks meet by number
    numbers = blocks.select("dim", "a_block")
    tiles = file.select("dim", "block").join(numbers, "dim").drop("dim").repartition("block", "a_block")
    met = tiles.join(file, "block").join(blocks.drop("dim"), "a_block").select("dim", "row", "id", "label", "codes", "a_id", "a_label", "a_v", "tops")
    return met.mapInArrow(run, "anchor long, slot int, row long, id long, low long, high long, sure boolean")


def scored(found: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """found without what the thresholds over all blocks rule out, with exact scores."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("low"), "id", "row")
    last = found.filter("sure").select("anchor", "slot", "low", "id", "row").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= WANTED).filter(F.col("n") == WANTED)
    cut = last.select("anchor", "slot", F.col("low").alias("t_low"), F.col("id").alias("t_id"))
    left = found.join(cut, ["anchor", "slot"], "left").filter("t_low IS NULL OR high > t_low OR (high = t_low AND id <= t_id)").select("anchor", "slot", "row", "id")
    exact = left.join(rows.select("row", "v"), "row").join(anchors.select(F.col("id").alias("anchor"), F.col("v").alias("a_v")), "anchor")
    score = F.aggregate(F.zip_with("v", "a_v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return exact.select("anchor", "slot", "row", "id", score.alias("score"))


def first(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= WANTED)


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that anchors picks.

    Components x count as floor(scale * x); scores are inner products and have to fit in 64 bits. An anchor's positives
    are the WANTED highest-scoring rows of its label with another id. For each positive come the WANTED highest-scoring
    rows of other labels whose score is at most the positive's and at least LOW_PERCENT % of it, which leaves none where
    the positive's score is below 0. Ties go to the smaller id. Rows with a null id, label or vector, an empty vector or a
    component that is null or not finite take no part; vectors of different length do not meet. A row that repeats in
    all of id, label and vector counts once; rows that share an id only are rows of their own, and of anchors that share
    an id the one with the smallest label and vector is taken.
    """
    good = usable(df.filter(F.col(label_col).isNotNull()), id_col, vector_col, scale, F.col(label_col).cast("long").alias("label"), anchors.alias("asked")).dropDuplicates(["id", "label", "v"])
    copies = Window.partitionBy("label", "v").orderBy("id")
    # an anchor stays among its copies: it is asked for, but as a candidate only if its place allows it
    placed = good.withColumn("n", F.row_number().over(copies)).filter((F.col("n") <= WANTED + 1) | F.col("asked"))
    rows = staged(placed.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", F.size("v").alias("dim"), "asked", (F.col("n") <= WANTED + 1).alias("meets")), "vectors")
    candidates = rows.filter("meets")
    cells = cells_of(rows)
    file = staged(approximated(candidates, cells), "approximations")
    chosen = rows.filter("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    chosen = staged(chosen.withColumn("tops", F.array().cast("array<long>")), "anchors")
    near = staged(survivors(staged(anchor_blocks(chosen), "anchor-blocks"), file, cells, negatives=False), "near")
    positives = staged(first(scored(near, rows, chosen)).select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = positives.groupBy(F.col("anchor").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("tops"))
    opened = chosen.drop("tops").join(tops, "id")
    hard = staged(survivors(staged(anchor_blocks(opened), "window-blocks"), file, cells, negatives=True), "hard")
    exact = scored(hard, rows, chosen).withColumn("slot", F.col("slot") + 1).join(positives, ["anchor", "slot"])
    inside = exact.filter((LOW_PERCENT * F.col("positive_score") <= 100 * F.col("score")) & (F.col("score") <= F.col("positive_score")))
    return first(inside).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH good AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), asked AS (SELECT * FROM good WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.v, a.label = c.label AS same, list_sum([a.v[i] * c.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
  FROM asked a JOIN good c ON len(c.v) = len(a.v) AND (a.label <> c.label OR a.vec_id <> c.vec_id)
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id, v) AS slot FROM scored WHERE same QUALIFY slot <= 5
), hard AS (
  SELECT p.anchor_id, p.slot, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.slot ORDER BY n.score DESC, n.vec_id, n.v)::INTEGER AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5
"""
