"""Exact top-k by inner product: tiled matrix products, partial selection in each tile, tree merging of lists.

Vectors are packed into blocks of rows. Each block of queries meets each block of candidates once, in a tile: one
matrix product of fixed size, whatever the table's. A tile keeps the k best of each query. A first merge joins the
lists of FAN tiles, a second those of FAN such groups, and so on until one list is left for each query; no task
ever holds more than FAN lists of a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodefinder.llm.common import staged

QUERY_ROWS, CANDIDATE_ROWS, FAN = 512, 4096, 16
#: A block's number is its partition's in the upper half, and its place there, from 1, in the lower.
PLACE = (1 << 32) - 1
BLOCK = "block long, dim int, n int, ids binary, rows binary"


def whole(column: str, scale: int) -> F.Column:
    """floor(scale * x) of each component as a double, then as a long."""
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(df: DataFrame, id_col: str, vector_col: str, scale: int, *more: F.Column) -> DataFrame:
    """(id, v) and more: vectors with a finite value in every component and at least one component, in whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    return good.select(F.col(id_col).cast("long").alias("id"), whole(vector_col, scale).alias("v"), *more)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of vectors packed into matrices of at most size rows of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, rows = held.pop(dim)
            made += 1
            values = [(part << 32) + made, dim, len(ids), np.array(ids, dtype=np.int64).tobytes(), np.concatenate(rows).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "dim", "n", "ids", "rows"])

        for batch in batches:
            vector = batch.column(1)
            ends = vector.offsets.to_numpy()
            flat = vector.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(batch.column(0).to_pylist()):
                v = flat[ends[i] : ends[i + 1]]
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(key)
                rows.append(v)
                if len(ids) == size:
                    yield close(len(v))
        for dim in list(held):
            yield close(dim)

    return vectors.mapInArrow(run, BLOCK)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where no sum can exceed 2**53, else in whole numbers."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores of each query, ties to the smaller vec, in order."""
    order = np.lexsort((vec, -score, query))
    query = query[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return order[place < k]


def top_k(df: DataFrame, queries: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition queries picks, its k highest products.

    Candidates are all rows but those with the query's own id. Components x count as floor(scale * x). Vectors that
    are null, empty or hold a null or a value that is not finite take no part; vectors of different length do not
    meet. Ties go to the smaller id; a row that repeats is a candidate each time, a query once.
    """
    candidates = staged(blocks(usable(df, id_col, vector_col, scale), CANDIDATE_ROWS), "candidates")
    asked = usable(df.filter(queries), id_col, vector_col, scale).dropDuplicates(["id"])
    asked = staged(blocks(asked, QUERY_ROWS), "queries")
    # every block of candidates gets the number of each block of queries; the blocks meet by number
    numbers = asked.select("dim", F.col("block").alias("q_block"))
    tiles = candidates.select(F.col("block").alias("c_block"), "dim").join(numbers, "dim")
    q = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    c = candidates.select(F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"))
    pairs = tiles.repartition(F.xxhash64("c_block", "q_block")).join(c, "c_block").join(q, "q_block").select("q_block", "c_block", "dim", "q_ids", "q_rows", "c_ids", "c_rows")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["c_ids"], dtype=np.int64)
                score = product(np.frombuffer(row["q_rows"], dtype=np.int64).reshape(len(q_ids), -1), np.frombuffer(row["c_rows"], dtype=np.int64).reshape(len(c_ids), -1))
                other = q_ids[:, None] != c_ids[None, :]
                low = np.iinfo(np.int64).min
                score = np.where(other, score, low)
                if len(c_ids) > k:  # all scores above or equal to the k-th; ties are settled below
                    cut = np.partition(score, len(c_ids) - k, axis=1)[:, len(c_ids) - k]
                    other &= score >= cut[:, None]
                at_q, at_c = np.nonzero(other)
                keep = best(at_q, c_ids[at_c], score[at_q, at_c], k)
                at_q, at_c = at_q[keep], at_c[keep]
                values = [row["q_block"], row["c_block"], q_ids[at_q].tobytes(), c_ids[at_c].tobytes(), score[at_q, at_c].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["q_block", "c_block", "q", "v", "s"])

    lists = staged(pairs.mapInArrow(tile, "q_block long, c_block long, q binary, v binary, s binary"), "tiles")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        q, v, s = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf[c]]) for c in "qvs")
        keep = best(q, v, s, k)
        return pd.DataFrame({"q_block": [pdf["q_block"].iloc[0]], "c_block": [pdf["c_block"].min()], "q": [q[keep].tobytes()], "v": [v[keep].tobytes()], "s": [s[keep].tobytes()]})

    n = candidates.count()
    ranked = lists.join(F.broadcast(numbered(candidates)), F.shiftright("c_block", 32) == F.col("part")).withColumn("node", F.col("before") + F.col("c_block").bitwiseAND(PLACE) - 1)
    while n > 1:
        ranked = ranked.withColumn("node", F.floor(F.col("node") / FAN))
        n = -(-n // FAN)
        merged = ranked.groupBy("q_block", "node").applyInPandas(lambda key, pdf: merge(pdf).assign(node=key[1]), "q_block long, c_block long, q binary, v binary, s binary, node long")
        ranked = staged(merged, "merged")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, v, s = (np.frombuffer(row[c], dtype=np.int64) for c in "qvs")
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
                rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(v), pa.array(s)], names=["query_id", "rank", "vec_id", "score"])

    return ranked.select("q", "v", "s").mapInArrow(unpack, "query_id long, rank int, vec_id long, score long")


def numbered(packed: DataFrame) -> DataFrame:
    """(part, before): for each partition that packed blocks, how many blocks those before it packed; one row a partition."""
    counts = packed.groupBy(F.shiftright("block", 32).alias("part")).agg(F.max(F.col("block").bitwiseAND(PLACE)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))


ORACLE = """
WITH good AS (
  SELECT row_number() OVER () AS pos, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), q AS (SELECT vec_id, any_value(v) AS v FROM good WHERE vec_id % 20 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.pos, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, pos)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
