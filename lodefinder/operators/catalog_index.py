"""Search of a catalog by relevance: an inverted index as tables, BM25, and the best few of each text.

A text's best releases are found without meeting every release that shares a word with it. At least n releases hold its
rarest word that is frequent enough, and each of them scores at least what that word gives in the longest release; a
release that holds none of the rarer words can not get there if all other words together give less. So only the
postings of a text's rare words are read, and the result is still exact.

Documents that hold the same asked words as often, in the same length, score the same for every text. They are one class,
and of a class the n smallest ids can be among the n best, the others can not. Texts meet classes, so that a word that all
documents share brings as many rows as there are classes, not documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodefinder.functions import text
from lodefinder.session import staged

#: BM25's saturation and length parameters, and the digits to which scores count (sums of doubles have no fixed order).
K1, B, DIGITS = 1.2, 0.75, 9
#: Words that one task counts, about, and texts in one file before they are dealt out: a task's memory does not grow with
#: the collection.
WORDS_A_TASK, ROWS_A_FILE = 1 << 18, 1 << 17


def release_names(title: Column) -> tuple[Column, Column]:
    """Artist and title of 'A - T' as a search shows it: what follows a second ' - ' is dropped; without one the title is all of it."""
    parts = F.split(F.coalesce(title, F.lit("")), " - ", -1)
    return text.trimmed(parts[0]), text.trimmed(F.coalesce(F.try_element_at(parts, F.lit(2)), title, F.lit("")))


def split_words(folded: Column) -> Column:
    return F.filter(F.split(folded, r"\s+"), lambda w: w != "")


def words_of(s: Column) -> Column:
    return split_words(text.folded(s))


@dataclass(frozen=True)
class Index:
    """postings (term, doc, tf, size), terms (term, df), and the collection's sizes."""

    postings: DataFrame
    terms: DataFrame
    docs: int
    mean_size: float
    longest: int

    @property
    def tasks(self) -> int:
        return math.ceil(self.docs * self.mean_size / WORDS_A_TASK) or 1

    def saturation(self, tf: Column | float, size: Column | int) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean_size))

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(float(self.docs)) - df + 0.5) / (df + 0.5))


def index_of(docs: DataFrame, id_col: str, text_col: Column) -> Index:
    """The inverted index of a table. Rows without words are in none of its lists."""
    folds = staged(docs.select(F.col(id_col).alias("doc"), text.folded(text_col).alias("s")), "folds", ROWS_A_FILE)
    words = folds.select(F.size(split_words(F.col("s"))).alias("size")).filter("size > 0")
    whole = words.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.max("size").alias("longest")).first()
    sized = Index(folds, folds, whole.n, whole.mean or 1.0, whole.longest or 1)
    words = folds.repartition(sized.tasks, "doc").select("doc", split_words(F.col("s")).alias("w"))
    each = words.select("doc", F.size("w").alias("size"), F.explode("w").alias("term"))
    postings = staged(each.groupBy("term", "doc", "size").agg(F.count("*").alias("tf")), "postings")
    terms = staged(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
    return replace(sized, postings=postings, terms=terms)


def needed_terms(queries: DataFrame, index: Index, n: int) -> DataFrame:
    """(q, term, idf, needed): each text's known words; a release among its n best holds one of the needed ones."""
    each = queries.select("q", F.explode(F.array_distinct(words_of(F.col("q")))).alias("term")).join(index.terms, "term")
    each = each.withColumn("idf", index.idf(F.col("df")))
    rare = Window.partitionBy("q").orderBy("df", "term")
    # what any release can get at most from a word: no limit of tf lifts it above K1 + 1
    later = F.coalesce(F.sum(F.col("idf") * (K1 + 1)).over(rare.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    sure = F.max(F.when(F.col("df") >= n, F.col("idf") * index.saturation(F.lit(1.0), F.lit(index.longest)))).over(Window.partitionBy("q"))
    # the first word whose successors can not make up for it is the last that is needed
    enough = F.coalesce(F.col("later") + 10.0**-DIGITS < F.col("sure"), F.lit(False))
    marked = each.withColumns({"later": later, "sure": sure}).withColumn("before", F.coalesce(F.max(enough.cast("int")).over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return marked.select("q", "term", "idf", (F.col("before") == 0).alias("needed"))


def classes_of(terms: DataFrame, index: Index, n: int) -> DataFrame:
    """(c, has, docs): the asked words, with size and tf, that some documents hold alike, and the n smallest of these (r, doc)."""
    asked = index.postings.join(terms.select("term").distinct(), "term", "left_semi").repartition(index.tasks, "doc")
    held = asked.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "size", "tf"))).alias("has"))
    w = Window.partitionBy("has").orderBy(F.asc_nulls_last("doc"))
    first = held.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return first.groupBy("has").agg(F.collect_list(F.struct("r", "doc")).alias("docs")).withColumn("c", F.monotonically_increasing_id())


def best_documents(queries: DataFrame, index: Index, n: int = 10) -> DataFrame:
    """(q, doc, score, rank): for each distinct text q the n documents of the highest BM25 score, ties to the smaller id.

    Only documents that share a word with the text have a score. Texts without words have no row.
    """
    terms = staged(needed_terms(queries, index, n), "needed")
    classes = staged(classes_of(terms, index, n), "classes")
    met = terms.filter("needed").join(classes.select("c", F.explode("has.term").alias("term")), "term").select("q", "c").distinct()
    idfs = terms.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idfs"))
    gain = lambda p: F.coalesce(F.try_element_at("idfs", p["term"]), F.lit(0.0)) * index.saturation(p["tf"], p["size"])
    score = F.round(F.aggregate("has", F.lit(0.0), lambda total, p: total + gain(p)), DIGITS)
    scored = met.join(idfs, "q").join(classes, "c").select("q", "docs", score.alias("score"), F.array_min("docs")["doc"].alias("first"))
    # n classes are enough: each of them has a document before any of a later class
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("first"))
    best = scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    each = best.select("q", F.explode("docs").alias("d"), "score").select("q", "d.doc", "score")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
