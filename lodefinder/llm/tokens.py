"""Token counts by a two-tier lookup: frequent pre-tokens from a broadcast table, the rest from worker caches.

A text's token count is the sum of its pre-tokens' counts. A table of the most frequent pre-tokens and their
counts is broadcast in compact form (at most table_size entries); what it lacks is encoded once in each worker
and kept in a bounded cache. No pre-token is ever shuffled. The table only saves time: counts do not depend on it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodefinder.llm.common import map_text

#: Entries of the broadcast table; documents it is learned from; entries of a worker's cache.
TABLE_SIZE, SAMPLE_DOCS, CACHE_SIZE = 65_536, 1_000, 1_000_000
LIMIT = 2048

#: Code points for which Python's lower() and the classes below agree with the tokenizer's Unicode tables. A text
#: with any other is encoded by the library as a whole.
SAFE_TOP = 0x250
_SAFE = [chr(c) for c in range(SAFE_TOP) if c != 0x130]


def char_class(*majors: str) -> str:
    return "".join(re.escape(c) for c in _SAFE if unicodedata.category(c)[0] in majors)


LETTERS, NUMBERS = char_class("L"), char_class("N")
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
UNSAFE = re.compile(f"[^{''.join(map(re.escape, _SAFE))}]")

#: What the word tokeniser's two tiers take: of the characters above those whose small letters are among them too, dashes,
#: quotation marks and other signs, the euro sign, Cyrillic letters, kana, CJK ideographs and Hangul syllables. None of
#: them is changed by normalisation on its own, and none joins with another.
_WIDE = [(0x2010, 0x2028), (0x2030, 0x205F), (0x20AC, 0x20AD), (0x400, 0x460), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]
_SMALL = set(_SAFE)
_WORDS = [c for c in _SAFE if set(c.lower()) <= _SMALL] + [chr(c) for a, b in _WIDE for c in range(a, b)]


def spans(chars) -> str:
    """The characters as ranges of a class."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


def wide_class(major: str) -> str:
    return spans(c for c in _WORDS if unicodedata.category(c)[0] == major)


WORD_LETTERS, WORD_NUMBERS = wide_class("L"), wide_class("N")
NOT_WORDS = re.compile(f"[^{spans(_WORDS)}]")
WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{WORD_LETTERS}]+|[{WORD_NUMBERS}]|[^{SPACES}{WORD_LETTERS}{WORD_NUMBERS}]+")


class WordLengths(dict):
    """Token count of each pre-token; what is missing is encoded and kept, up to CACHE_SIZE entries."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) < CACHE_SIZE:
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if NOT_WORDS.search(text) or self.special.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, WORD_PATTERN.findall(text.lower())))


_CACHES: dict[str, WordLengths] = {}


def lengths_of(name: str) -> WordLengths:
    """This worker's cache for a tokenizer; it lives as long as the worker."""
    if name not in _CACHES:
        _CACHES[name] = WordLengths(Tokenizer.from_file(public_tokenizers.path(name)))
    return _CACHES[name]


def frequent_words(docs: DataFrame, text_col: str, sample_docs: int, table_size: int) -> list[str]:
    """The most frequent pre-tokens of sample_docs documents, whichever come first: at most table_size short strings."""
    seen = Counter()
    for (x,) in docs.select(text_col).take(sample_docs):  # reads only as many partitions as it needs
        if x and not NOT_WORDS.search(x):
            seen.update(w for w in WORD_PATTERN.findall(x.lower()) if len(w) <= 64)
    return sorted(w for w, _ in seen.most_common(table_size))


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs, over whole texts.

    Null and empty texts have 0 bytes and 0 tokens. Strings of special tokens inside a text count as the library
    counts them by default. tokenizer: a file of public_tokenizers whose pre-tokeniser is the word pattern above.
    """
    lib = lengths_of(tokenizer)
    words = frequent_words(docs, text_col, sample_docs, table_size)
    blob = ("\n".join(words).encode(), bytes(min(lib[w], 255) for w in words))
    table = docs.sparkSession.sparkContext.broadcast(blob)

    def start():
        lookup = lengths_of(tokenizer)
        if not getattr(lookup, "filled", False):
            text, counts = table.value
            lookup.update((w, n) for w, n in zip(text.decode().split("\n"), counts, strict=False) if n < 255)
            lookup.filled = True

        def compute(texts):
            return [[len(x.encode()) if x else 0 for x in texts], [lookup.count(x) for x in texts]]

        return compute

    taken = fresh_names(id_col, "n_bytes", "n_tokens")
    out = map_text(docs, text_col, [id_col], [(taken[0], T.LongType()), (taken[1], T.LongType())], start)
    return out.withColumn("over_limit", F.col(taken[1]) > limit)


def fresh_names(id_col: str, *names: str) -> list[str]:
    if id_col in names:
        raise ValueError(f"{id_col} is the name of a result column")
    return list(names)
