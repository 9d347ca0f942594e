"""Byte-level BPE by a queue of merge ranks in a hierarchical bitmap, and decoding.

Texts are cut into pre-tokens by a pattern. All new pre-tokens of a run of texts are merged together: their bytes form
one linked list, with a wall after each, and each pair of neighbours whose joined bytes have a rank waits in the bucket
of that rank. A bit for each bucket, 256 of them in a word, and above them a bit for each word say where the lowest
rank is in two find-first-set steps; a merge costs the same in a pre-token of a dozen bytes and in one of millions.
Entries whose pair has changed since are skipped when they come up. Pre-tokens do not touch one another, so that the
lowest rank of all is as good a next step for each as its own lowest; within a bucket the leftmost position goes first.

Each worker keeps the ids of short pre-tokens in two generations of bounded size. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodefinder.llm.common import map_text
from lodefinder.llm.tokens import LETTERS, NUMBERS, SPACES, UNSAFE

#: Pre-tokens in a generation of a worker's cache, the longest that is kept, and characters of a run of texts.
CACHE_SIZE, CACHE_LENGTH, RUN_CHARS = 400_000, 64, 250_000
SHIFT = 8
LOW = (1 << SHIFT) - 1

#: public_tokenizers.PATTERN for texts of characters below U+0250: words first, as no other branch starts with a letter.
QUICK = re.compile(f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class Strings:
    """A byte string for each number; numbers are spelled out by one gather."""

    def __init__(self, of: dict[int, bytes]) -> None:
        self.size = np.zeros(max(of) + 1, dtype=np.int64)
        self.start = np.zeros(max(of) + 1, dtype=np.int64)
        at = 0
        for i, b in of.items():
            self.start[i], self.size[i] = at, len(b)
            at += len(b)
        self.bytes = np.frombuffer(b"".join(of.values()), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        where = np.repeat(self.start[ids] - (ends - size), size)
        where += np.arange(len(where))
        return self.bytes[where].tobytes()


class Encoder:
    """Ids of texts by the ranks of byte strings; every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("a byte has no rank")
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.quick = QUICK.findall if pattern == public_tokenizers.PATTERN else None
        self.spelling = Strings({i: b for b, i in ranks.items()})
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)])
        self.of_pair = np.full(1 << 16, -1)
        for b, i in ranks.items():
            if len(b) == 2:
                self.of_pair[b[0] << 8 | b[1]] = i
        self.words = [0] * ((max(ranks.values()) >> SHIFT) + 1)
        #: Ids as unsigned 32-bit integers.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.quick(text) if self.quick and not UNSAFE.search(text) else self.split(text)

    def merged(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each piece: itself if it has a rank, else what merging its bytes by rank leaves."""
        rank_of = self.ranks.get
        split = [x for x in pieces if x not in self.ranks]
        data = b"\0" + b"\0".join(split) + b"\0"
        raw = np.frombuffer(data, dtype=np.uint8)
        walls = np.cumsum([0, *(len(x) + 1 for x in split)])
        wall = bytearray(len(data))
        np.frombuffer(wall, dtype=np.uint8)[walls] = 1
        # the token at i ends at after[i] and is tokens[i]; waits[i] is the rank of it and its right neighbour, or -1
        after, before, tokens = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1)), self.of_byte[raw].tolist()
        first = np.append(self.of_pair[raw[:-1].astype(np.int64) << 8 | raw[1:]], -1)
        first[walls] = -1
        first[walls[1:] - 1] = -1
        waits, buckets, words, top = first.tolist(), {}, self.words, 0
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        for group in np.split(at, np.flatnonzero(np.diff(first[at])) + 1) if len(at) else []:
            rank = waits[group[0]]
            buckets[rank] = group.tolist()
            words[rank >> SHIFT] |= 1 << (rank & LOW)
            top |= 1 << (rank >> SHIFT)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = (high << SHIFT) + (word & -word).bit_length() - 1
            words[high] = word = word & (word - 1)
            if not word:
                top &= top - 1
            bucket, lower = iter(sorted(buckets.pop(rank))), False
            for i in bucket:
                if waits[i] != rank:
                    continue  # stale: one of the two is part of another token by now
                gone = after[i]
                end = after[i] = after[gone]
                before[end], waits[gone], tokens[i], waits[i] = i, -1, rank, -1
                # both pairs that the new token is part of wait anew
                if not wall[end] and (new := rank_of(data[i : after[end]])) is not None:
                    waits[i] = new
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        words[new >> SHIFT] |= 1 << (new & LOW)
                        top |= 1 << (new >> SHIFT)
                    lower = new < rank
                left = before[i]
                if not wall[left]:
                    waits[left] = -1
                    if (new := rank_of(data[left:end])) is not None:
                        waits[left] = new
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            words[new >> SHIFT] |= 1 << (new & LOW)
                            top |= 1 << (new >> SHIFT)
                        lower = lower or new < rank
                if lower:  # a lower rank goes first; the rest of this bucket waits on
                    if rest := list(bucket):
                        buckets[rank] = rest
                        words[rank >> SHIFT] |= 1 << (rank & LOW)
                        top |= 1 << (rank >> SHIFT)
        start = 1
        for piece in pieces:
            if (rank := rank_of(piece)) is not None:
                yield [rank]
                continue
            ids, i = [], start
            while not wall[i]:
                ids.append(tokens[i])
                i = after[i]
            start = i + 1
            yield ids

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null and empty ones have none."""
        todo, texts = iter(texts), list(texts)
        ends = np.cumsum([len(x or "") for x in texts]) // RUN_CHARS
        for n in np.unique(ends, return_counts=True)[1]:
            parts = [self.pieces(x) if x else [] for x in islice(todo, int(n))]
            if len(self.young) >= CACHE_SIZE:
                self.old, self.young = self.young, {}
            known, old = self.young, self.old
            new = set().union(*parts).difference(known)
            known.update((x, old[x]) for x in new if x in old)
            new = [x for x in new if x not in old]
            known.update((x, array("I", ids).tobytes()) for x, ids in zip(new, self.merged([x.encode() for x in new]), strict=True))
            for x in parts:
                yield np.frombuffer(b"".join(map(known.__getitem__, x)), dtype=np.uint32)
            for x in new:
                if len(x) > CACHE_LENGTH:
                    del known[x]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spelling.joined(ids)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(ranks_file: str, pattern: str) -> Encoder:
    """This worker's encoder of a file of ranks: lines of base64 bytes and rank."""
    if (ranks_file, pattern) not in _ENCODERS:
        with open(public_tokenizers.path(ranks_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks_file, pattern] = Encoder(ranks, pattern)
    return _ENCODERS[ranks_file, pattern]


RANKS = "byte_bpe_multi_50k.tiktoken"


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", ranks_file: str = RANKS, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """The kept columns, the ids of each whole text (array of int) and, unless decoded_col is None, the bytes they decode to.

    Null and empty texts have no ids and decode to no bytes. Strings of special tokens are ordinary text. Repeated
    rows are encoded each; an empty table gives an empty result with the same columns.
    """
    fields = [(ids_col, T.ArrayType(T.IntegerType()))] + [(decoded_col, T.BinaryType())] * bool(decoded_col)

    def start():
        known = encoder_of(ranks_file, pattern)

        def compute(texts):
            ids = list(known.encode(texts))
            return [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), [known.decode(x) for x in ids]][: len(fields)]

        return compute

    return map_text(docs, text_col, keep, fields, start)


def encode_digest(docs: DataFrame, keep: list[str], text_col: str = "text", ranks_file: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""

    def start():
        known = encoder_of(ranks_file, pattern)
        decimal = Strings({i: b"%d," % i for i in known.ranks.values()})
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def compute(texts):
            sizes, of_ids, of_bytes = [], [], []
            for ids in known.encode(texts):
                sizes.append(len(ids))
                of_ids.append(digest(decimal.joined(ids)[:-1]))
                of_bytes.append(digest(known.decode(ids)))
            return [sizes, of_ids, of_bytes]

        return compute

    return map_text(docs, text_col, keep, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], start)
