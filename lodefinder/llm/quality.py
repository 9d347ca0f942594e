"""Quality rules: line frequency across the documents of a host, and rules on single documents.

A line is normalised (A-Z lower-cased, digits to 0, runs of white space to one space) and hashed. For each source
(the host of a document) and line, the distinct documents that hold it are counted, over all documents; documents
with the same set of lines and near-duplicates are copies and count once, else a copied text would make boilerplate of
itself. Near-duplicates are sought among all documents, by sketches that the first pass over the texts makes: the share
of slots of two SuperMinHash signatures that agree estimates their similarity, so no text or set is shuffled. Lines in
more than LINE_DOCS distinct documents of their source, however large it is, are boilerplate and are
removed; a document whose remaining words are fewer than LEFT_WORDS, or less than LEFT_SHARE of its words, is
depleted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.llm import dedup
from lodefinder.llm.common import fresh, map_text, staged

#: LINE_SHARE is read by the SQL only: the limit on distinct documents does not grow with a source.
LINE_DOCS, LINE_SHARE, LEFT_WORDS, LEFT_SHARE = 20, 0.001, 20, 0.3
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]+")
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[str]) -> int:
    """How many words lie in a 3-word window that the text holds at least twice."""
    if len(words) < 4:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    # windows as numbers: pairs are renumbered, so that no product leaves 64 bits
    _, pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    often = count[which] > 1
    hit = np.zeros(len(words), dtype=bool)
    for i in range(3):
        hit[i : i + len(often)] |= often
    return int(hit.sum())


def base_of(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat_words(words)


def normal_line(line: str) -> str:
    """'' for a line without words."""
    return DIGITS.sub("0", WHITE.sub(" ", line.translate(LOWER)).strip(" "))


LOWER = {c: c + 32 for c in range(65, 91)}


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Signed 64-bit hashes of the distinct normalised lines that have words, and the words under each."""
    words: dict[str, int] = {}
    for line in text.split("\n"):
        if name := normal_line(line):
            words[name] = words.get(name, 0) + name.count(" ") + 1
    hashed = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in words], dtype=np.uint64).view(np.int64)
    return hashed.tolist(), list(words.values())


def copies_of(base: DataFrame) -> DataFrame:
    """(text_key, class) for rows (text_key, content, n, bands, slots): one class for what near-duplicates and equal contents link, over any number of steps.

    A text without any link may be absent; it is a class of its own.
    """
    contents = base.filter("n > 0").select("text_key", "content").distinct()
    low = contents.groupBy("content").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low < high")
    equal = contents.join(low, "content").filter("text_key <> low").select(F.col("text_key").alias("a"), F.col("low").alias("b"))
    groups = dedup.sketch_groups(base.select(F.col("text_key").alias("id"), "n", "bands", "slots"), staged(equal, "links"))
    return groups.select(F.col("node").alias("text_key"), F.col("component").alias("class"))


def quality(docs: DataFrame, keep: list[str], text_col: str = "text", source_col: str = "source", names: dict[str, str] | None = None) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words, base_failed, kept.

    n_line_words: the words on lines that are removed as boilerplate. A null text is empty, and so fails the base
    rules; documents with a null source form a source of their own. names renames result columns that would clash.
    """
    names = {n: (names or {}).get(n, n) for n in [*FIELDS, "n_line_words", "base_failed", "kept"]}
    made = ("text_key", "line_hashes", "line_words", "line_source", "n_shingles", "bands", "slots")
    key, lines, counts, source, *sketch = (fresh(n, [*docs.columns, *names.values()]) for n in made)

    def start():
        def compute(texts):
            base = [base_of(x) for x in texts]
            found = [line_hashes(x) if x else ([], []) for x in texts]
            return [*([b[i] for b in base] for i in range(5)), [f[0] for f in found], [f[1] for f in found], *dedup.sketch_of(texts)]

        return compute

    fields = [(names[n], T.LongType()) for n in FIELDS] + [(lines, T.ArrayType(T.LongType())), (counts, T.ArrayType(T.LongType()))]
    fields += list(zip(sketch, (T.LongType(), T.ArrayType(T.LongType()), T.BinaryType()), strict=True))
    # a text's hash stands for the document: rows with one text are copies, whatever their ids
    keyed = docs.withColumn(source, F.xxhash64(F.coalesce(F.col(source_col), F.lit("\0")))).withColumn(key, F.xxhash64(text_col))
    base = staged(map_text(keyed, text_col, [*keep, source, key], fields, start), "quality")
    content = F.xxhash64(F.array_sort(lines)).alias("content")
    long = base.select(F.col(key).alias("text_key"), F.col(source).alias("source"), content, F.explode(F.arrays_zip(F.col(lines).alias("line"), F.col(counts).alias("words"))).alias("x"))
    long = long.select("text_key", "source", "content", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    # classes merge contents, so only lines with enough contents can have enough classes
    often = staged(long.select("source", "line", "content").distinct().groupBy("source", "line").agg(F.count("*").alias("n")).filter(F.col("n") > LINE_DOCS).select("source", "line"), "lines")
    if not often.isEmpty():
        hits = long.join(often, ["source", "line"]).groupBy("text_key", "source").agg(F.collect_set("line").alias("lines"))
        copies = copies_of(base.select(F.col(key).alias("text_key"), content, *(F.col(c).alias(n) for c, n in zip(sketch, ("n", "bands", "slots"), strict=True))))
        held = hits.join(copies, "text_key", "left").select("source", F.explode("lines").alias("line"), F.coalesce("class", "text_key").alias("class")).distinct()
        often = staged(held.groupBy("source", "line").agg(F.count("*").alias("n")).filter(F.col("n") > LINE_DOCS).select("source", "line"), "lines")
    once = long.join(often, ["source", "line"]).groupBy("text_key", "source", "line").agg(F.max("words").alias("words"))
    removed = once.groupBy(F.col("text_key").alias(key), F.col("source").alias(source)).agg(F.sum("words").alias(names["n_line_words"]))
    out = base.drop(lines, counts, *sketch).join(removed, [key, source], "left")
    n, gone, repeated = F.col(names["n_words"]), F.coalesce(names["n_line_words"], F.lit(0)).cast("long"), F.col(names["n_repeat_words"])
    failed = (n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
    depleted = (gone > 0) & ((n - gone < LEFT_WORDS) | (n - gone < LEFT_SHARE * n))
    return out.select(*keep, *(names[x] for x in FIELDS), gone.alias(names["n_line_words"]), failed.alias(names["base_failed"]), (~failed & ~depleted).alias(names["kept"]))
