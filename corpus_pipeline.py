"""The corpus pipeline: toxic, depleted and repeated documents go; the rest is mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir). Its rows are written as Parquet and read again as the next one's docs. All
but the last return the columns of docs. SQL cannot express the first stage, so there is no oracle; tests hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefinder.llm import dedup, mixing, quality, toxicity, wfst
from lodefinder.llm.common import drop_staged, fresh, read_table, staged

#: Shares of tokens after mixing, and the rate of surely clean documents: a little over 1, so that they stay.
TARGETS, ANCHOR = {"clean": 0.95, "low": 0.05}, ("clean", 1.1)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5, by a classifier of the labels outside fold 0 of 5."""
    labels = read_table(spark, sf_dir, "labels")
    texts = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(texts, labels.filter(toxicity.in_fold("doc_id") != 0))
    score = fresh("score", docs.columns)
    return toxicity.toxicity_scores(docs, model, docs.columns, score_col=score).filter(F.col(score) < 0.5).select(*docs.columns)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on single documents and are not depleted of lines that their source repeats."""
    names = {n: fresh(n, docs.columns) for n in [*quality.FIELDS, "n_line_words", "base_failed", "kept"]}
    return quality.quality(docs, docs.columns, names=names).filter(F.col(names["kept"])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of rows that repeat an id, one."""
    groups = dedup.near_duplicates(docs)
    left = docs.join(groups.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    return left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(left.filter("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, which may be more than once or not at all."""
    names = {n: fresh(n, docs.columns) for n in ["n_tokens", "rate", "copies", *(f"p_{d}" for d in TARGETS)]}
    copies = names["copies"]
    made = mixing.mixed(docs, read_table(spark, sf_dir, "labels"), docs.columns, TARGETS, ANCHOR, names=names)
    each = fresh("each", made.columns)
    return made.filter(F.col(copies) > 0).withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip): piece ids of each text, and whether decoding them gives it back."""
    made = wfst.encode(docs.select("doc_id", "text"), ["doc_id", "text"])
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), wfst.MARK, " ")
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [("toxicity", reject_toxic), ("quality rules", reject_poor), ("near-duplicates", drop_copies), ("mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each table between two stages is deleted once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
