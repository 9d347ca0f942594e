"""URL filters: rules by host and path, and for the rest naive Bayes over segmented host and path words.

A unigram lexicon of at most LEXICON words, the most frequent of all pages' texts, is counted once; words of one
count are in it together or not at all. Names that run words together are split by Viterbi search for the most likely sequence of words. Pages that a rule decides are the
training examples: their host and path words are counted for each verdict over all pages, and a multinomial naive
Bayes classifier with these counts judges the pages that no rule fits. Words are those of the lexicon, numbers, or
"unknown", so the tables that are broadcast are bounded by LEXICON.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.llm.common import map_text, staged, tune

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
LEXICON, MAX_WORD, CACHE_SIZE = 50_000, 24, 500_000
#: Parts of the range of counts in which one step looks for the lexicon's least count.
RANGES = 1024
TAG = re.compile(r"<[^>]*>")
WORD = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"[^\W\d_]+|\d+")
UNKNOWN, NUMBER = "?", "0"
UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null or without '://'."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = re.search(r"[/?#]", rest)
    host, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return host.translate(UPPER), re.split(r"[?#]", tail, maxsplit=1)[0]


class Rules:
    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for text, verdict in rules:
            host, slash, path = text.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, text, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule whose host is this one or a parent, and whose path begins this one; and its verdict."""
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for start, text, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(text) > len(best[0])):
                    best = (text, verdict)
        return best


class Segmenter:
    """Splits a name into words of the lexicon; stretches that it lacks cost more the longer they are."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.strange = math.log(total) + math.log(10)
        self.known: dict[str, list[str]] = {}

    def words(self, name: str) -> list[str]:
        """The most likely words, unknown stretches as UNKNOWN; ties go to the longer last word."""
        if (found := self.known.get(name)) is None:
            best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
            for end in range(1, len(name) + 1):
                for begin in range(max(0, end - MAX_WORD), end):
                    word = name[begin:end]
                    cost = best[begin] + self.cost.get(word, self.strange + math.log(10) * (end - begin))
                    if cost < best[end]:
                        best[end], back[end] = cost, begin
            found, end = [], len(name)
            while end:
                word = name[back[end] : end]
                found.append(word if word in self.cost else UNKNOWN)
                end = back[end]
            found.reverse()
            if len(self.known) >= CACHE_SIZE:
                self.known.clear()
            self.known[name] = found
        return found

    def tokens(self, host: str, path: str) -> list[str]:
        out = []
        for mark, text in (("h", host), ("p", path.lower())):
            for piece in PIECE.findall(text):
                out += [f"{mark}:{NUMBER}"] if piece[0].isdigit() else [f"{mark}:{w}" for w in self.words(piece)]
        return out


def least_count(counted: DataFrame, size: int) -> int:
    """The smallest count that at most size rows of counted (w, n) reach.

    Each step splits the open range into RANGES parts and counts the rows in each, so
    the driver sees at most RANGES numbers a step, and a few steps find the count whatever the table's size.
    """
    low, high, above = 1, (counted.agg(F.max("n")).first()[0] or 0) + 1, 0
    while low < high:
        step = -(-(high - low) // RANGES)
        part = F.floor((F.col("n") - low) / step).alias("part")
        found = dict(map(tuple, counted.filter((F.col("n") >= low) & (F.col("n") < high)).groupBy(part).count().collect()))
        for p in range((high - 1 - low) // step, -1, -1):
            if above + found.get(p, 0) > size:
                low, high = (low + p * step, min(high, low + (p + 1) * step)) if step > 1 else (low + p + 1, low + p + 1)
                break
            above += found.get(p, 0)
        else:
            high = low
    return low


def lexicon_of(pages: DataFrame, html_col: str, size: int = LEXICON) -> dict[str, int]:
    """The most frequent words of all pages' texts without tags, at most size, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
            seen.clear()
            return made

        for batch in batches:
            for html in batch.column(0).to_pylist():
                if html:
                    seen.update(w for w in WORD.findall(TAG.sub(" ", html).lower()) if len(w) <= MAX_WORD)
            if len(seen) > 500_000:
                yield flush()
        yield flush()

    tune(pages.sparkSession)
    counted = staged(pages.select(html_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    return {r["w"]: r["n"] for r in counted.filter(F.col("n") >= least_count(counted, size)).collect()}


#: This worker's segmenter, by the lexicon's name.
_SEGMENTERS: dict[str, Segmenter] = {}


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages.

    rule and verdict are the longest fitting rule's; without one, rule is null and the classifier decides: block if
    that is likelier. If the rules decide no page, or all alike, the rest is allowed, or judged as they are.
    """
    rules = rules if rules is not None else RULES
    context = pages.sparkSession.sparkContext
    lexicon, name = context.broadcast(lexicon_of(pages, html_col)), uuid.uuid4().hex

    def segmenter() -> Segmenter:
        if name not in _SEGMENTERS:
            _SEGMENTERS.clear()
            _SEGMENTERS[name] = Segmenter(lexicon.value)
        return _SEGMENTERS[name]

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, book, seen = segmenter(), Rules(rules), Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                host, path = split_url(url)
                if found := book.match(host, path):
                    seen.update((found[1], t) for t in ["", *seg.tokens(host, path)])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["verdict", "token", "n"])

    # at most 4 * (LEXICON + 2) rows: two verdicts, two places
    rows = pages.select(url_col).mapInArrow(examples, "verdict string, token string, n long").groupBy("verdict", "token").agg(F.sum("n").alias("n")).collect()
    model = context.broadcast(odds_of([(r["verdict"], r["token"], r["n"]) for r in rows]))

    def start():
        seg, book = segmenter(), Rules(rules)
        prior, odds, other = model.value

        def compute(urls):
            hosts, paths, names, verdicts = [], [], [], []
            for url in urls:
                host, path = split_url(url)
                found = book.match(host, path)
                hosts.append(host)
                paths.append(path)
                names.append(found[0] if found else None)
                verdicts.append(found[1] if found else "block" if prior + sum(odds.get(t, other) for t in seg.tokens(host, path)) > 0 else "allow")
            return [hosts, paths, names, verdicts]

        return compute

    return map_text(pages, url_col, [id_col], [(n, T.StringType()) for n in ("host", "path", "rule", "verdict")], start)


def odds_of(rows: list[tuple[str, str, int]]) -> tuple[float, dict[str, float], float]:
    """Log odds of block: of the prior, of each word (with add-one smoothing), of a word that training lacks."""
    docs = {v: n for v, t, n in rows if not t}
    counts = {(v, t): n for v, t, n in rows if t}
    vocabulary = {t for _, t in counts}
    size = {v: sum(n for (u, _), n in counts.items() if u == v) + len(vocabulary) + 1 for v in ("allow", "block")}
    prior = math.log((docs.get("block", 0) + 0.5) / (docs.get("allow", 0) + 0.5)) if docs else -1.0
    if len(docs) < 2:
        return prior, {}, 0.0
    shift = math.log(size["allow"] / size["block"])
    return prior, {t: math.log((counts.get(("block", t), 0) + 1) / (counts.get(("allow", t), 0) + 1)) + shift for t in vocabulary}, shift
