"""Language-model scores from Elias-Fano n-gram tries.

1. Blocks. A map over the texts packs runs of documents of about BLOCK_TOKENS tokens: local word numbers, the words'
   64-bit hashes, training counts. Blocks are written to the shared folder; texts are not read again.
2. Messages. A block sends each shard its distinct words and bigrams, with their training counts: bigrams go to
   the shard of their context, those of the few contexts that are too frequent for one shard to a shard of their own
   hash. So each distinct n-gram of a block is sent once, however often it occurs.
3. Tries. A shard sums the messages into a trie of two levels in anonymous memory maps: contexts as an Elias-Fano
   sequence of hashes, monotone pointers to their successors as another, successors as a third, made monotone by
   their context's rank, and for each the smoothed probability as a 16-bit logarithm. A message is answered in its
   own order by searching successors relative to their context.
4. Scores. A block and its answers meet again, and documents are scored with P(w | v) = a(v w) + b(v) P(w), where
   a = c(v w) / (c(v) + MU), b = MU / (c(v) + MU) and P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), a Dirichlet prior on
   the unigram; a text's first token has P(w).

The model is never held in one place: it is spread over as many shards as its size asks for. Only the contexts of
more than 1/HOT of a shard's share of tokens are broadcast; their number is at most HOT times the shards.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefinder.llm.common import staged, tune
from lodefinder.llm.dedup import mix

BLOCK_TOKENS, SHARD_GRAMS, HOT, MU = 4_000_000, 2_000_000, 4, 32.0
#: The end of a text; no word holds white space.
END = b"\n"
#: Code of an n-gram that training lacks; the others are -log10(p) * STEP.
UNSEEN, STEP = 0xFFFF, 4096
FP_BITS = 40
U64 = np.uint64


def packed(x: np.ndarray) -> bytes:
    """An array as zstd-compressed byte planes: the high planes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def mapped(x: np.ndarray) -> np.ndarray:
    """A copy of x in an anonymous memory map."""
    if not x.nbytes:
        return x
    room = np.frombuffer(mmap.mmap(-1, x.nbytes), dtype=x.dtype)
    room[:] = x
    return room


class EliasFano:
    """A sorted sequence of numbers below 2**64 in about 2 + log2(universe / n) bits each."""

    def __init__(self, values: np.ndarray) -> None:
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        self.high_top = top >> self.low_bits
        self.mask = U64((1 << self.low_bits) - 1)
        low = np.zeros(self.n * self.low_bits // 64 + 2, dtype=np.uint64)
        if self.low_bits and self.n:
            bit = np.arange(self.n, dtype=np.uint64) * U64(self.low_bits)
            word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
            field = values & self.mask
            np.bitwise_or.at(low, word, field << shift)
            over = shift + U64(self.low_bits) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, field[over] >> (U64(64) - shift[over]))
        self.low = mapped(low)
        high = np.zeros(self.n + self.high_top + 1 + 64, dtype=bool)
        if self.n:
            high[(values >> U64(self.low_bits)).astype(np.int64) + np.arange(self.n)] = True
        bits = np.packbits(high[: len(high) // 64 * 64], bitorder="little").view(np.uint64)
        self.high = mapped(bits)
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ones = mapped(np.concatenate([[0], np.cumsum(ones)]))
        self.zeros = mapped(np.arange(len(bits) + 1) * 64 - self.ones)

    @staticmethod
    def in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one (from 0) of each 64-bit word."""
        at, k = np.zeros(len(word), dtype=np.uint64), k.astype(np.int64).copy()
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((word >> at) & U64((1 << width) - 1)).astype(np.int64)
            beyond = k >= count
            k -= np.where(beyond, count, 0)
            at += np.where(beyond, U64(width), U64(0))
        return at.astype(np.int64)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one or zero of the high bits."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        bits = self.high[word]
        return word * 64 + self.in_word(bits if one else ~bits, k - before[word])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i.astype(np.uint64) * U64(self.low_bits)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        high_part = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.low[word] >> shift) | high_part) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i, True) - i).astype(np.uint64) << U64(self.low_bits)) | self.lows(i)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each value (its first), or -1; begin and end bound where to look, such as a context's successors."""
        if not self.n or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        high = np.minimum(values >> U64(self.low_bits), U64(self.high_top + 1)).astype(np.int64)
        inside = high <= self.high_top
        h = np.where(inside, high, 0)
        lo = np.where(h > 0, self.select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        hi = np.where(inside, self.select(h, False) - h, lo)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        want, stop = values & self.mask, hi.copy()
        while (going := lo < hi).any():
            mid = (lo + hi) // 2
            less = going & (self.lows(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(going & ~less, mid, hi)
        found = lo < stop
        found &= self.lows(np.minimum(lo, self.n - 1)) == want
        return np.where(found, lo, -1)


class Trie:
    """Contexts, pointers, successors, and quantised probabilities of a shard's bigrams."""

    def __init__(self, contexts: np.ndarray, totals: np.ndarray, key: np.ndarray, counts: np.ndarray) -> None:
        """key: context rank << FP_BITS | successor, sorted, of n-grams that training has; totals by context."""
        rank = (key >> U64(FP_BITS)).astype(np.int64)
        self.contexts = EliasFano(contexts)
        self.pointers = EliasFano(np.searchsorted(rank, np.arange(len(contexts) + 1)))
        self.successors = EliasFano(key)
        self.codes = mapped(coded(counts / (totals[rank] + MU)))
        self.backoff = mapped(coded(MU / (totals + MU)))

    def query(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of b for each context and of a for each of its successors."""
        at = self.contexts.find(contexts)
        safe = np.maximum(at, 0)
        backoff = np.where(at >= 0, self.backoff[safe], coded(np.ones(1))[0]) if len(self.backoff) else np.zeros(len(at), dtype=np.uint16)
        if not self.successors.n:
            return backoff, np.full(len(successors), UNSEEN, dtype=np.uint16)
        begin, end = self.pointers[safe], self.pointers[safe + 1]
        of = np.repeat(np.arange(len(contexts)), sizes)
        key = (safe[of].astype(np.uint64) << U64(FP_BITS)) | successors
        found = self.successors.find(key, begin[of].astype(np.int64), np.where(at[of] >= 0, end[of].astype(np.int64), 0))
        return backoff, np.where(found >= 0, self.codes[np.maximum(found, 0)], np.uint16(UNSEEN))


def coded(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(p) * STEP), UNSEEN - 1).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code == UNSEEN, 0.0, 10.0 ** (-code.astype(np.float64) / STEP))


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOCK_SCHEMA = "block long, doc_ids array<long>, named array<boolean>, held array<boolean>, sizes array<int>, words binary, counts binary, ids binary"


def blocks_of(docs: DataFrame, id_col: str, text_col: str, held: F.Column) -> DataFrame:
    tune(docs.sparkSession)
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        numbers, doc_ids, flags, sizes, ids = Numbers(), [], [], [], []

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            total = np.bincount(flat, minlength=len(numbers))
            train = np.bincount(flat, weights=np.repeat(~np.array(flags), sizes), minlength=len(numbers)).astype(np.uint32)
            order = np.argsort(-total, kind="stable")
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order))
            words = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], dtype=np.uint64)
            row = [(part << 32) + made, [x or 0 for x in doc_ids], [x is not None for x in doc_ids], flags, sizes, words[order].tobytes(), packed(train[order]), packed(place[flat])]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        held_tokens = 0
        for batch in batches:
            for doc_id, text, is_held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().lower().split() if text else []
                words.append(END)
                ids.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                doc_ids.append(doc_id)
                flags.append(bool(is_held))
                sizes.append(len(words))
                held_tokens += len(words)
                if held_tokens >= BLOCK_TOKENS:
                    yield close()
                    made, held_tokens = made + 1, 0
                    numbers, doc_ids, flags, sizes, ids = Numbers(), [], [], [], []
        if ids:
            yield close()

    return docs.select(F.col(id_col).cast("long"), text_col, F.coalesce(held, F.lit(False))).mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """A block's words by rank of hash, and its distinct bigrams in the order in which they are sent."""

    def __init__(self, words: bytes, counts: bytes, ids: bytes, sizes, held, shards: int, hot: np.ndarray) -> None:
        hashes = np.frombuffer(words, dtype=np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.words, self.counts = hashes[order], unpacked(counts, np.uint32)[order]
        self.ids, self.sizes = place[unpacked(ids, np.uint32)], np.asarray(sizes, dtype=np.int64)
        self.word_shard = (mix(self.words) % U64(shards)).astype(np.int32)
        first = np.cumsum(self.sizes) - self.sizes
        inner = np.ones(len(self.ids), dtype=bool)
        inner[first] = False  # tokens that have one before them in their text
        self.inner = np.flatnonzero(inner)
        pair = (self.ids[self.inner - 1] << 32) | self.ids[self.inner]
        self.pairs, self.inverse = np.unique(pair, return_inverse=True)
        train = np.repeat(~np.asarray(held, dtype=bool), self.sizes)[self.inner]
        self.pair_counts = np.bincount(self.inverse, weights=train, minlength=len(self.pairs)).astype(np.uint32)
        context, word = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        self.context = context
        self.successor = self.words[word] >> U64(64 - FP_BITS)
        keys = self.words[context].copy()
        split = np.isin(self.words, hot)[context]
        keys[split] ^= mix(self.successor[split] + U64(1))
        self.pair_shard = (mix(keys ^ U64(0x5555555555555555)) % U64(shards)).astype(np.int32)
        self.word_order, self.word_cut = self.cut(self.word_shard, shards)
        self.pair_order, self.pair_cut = self.cut(self.pair_shard, shards)

    @staticmethod
    def cut(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def message(self, s: int) -> tuple | None:
        w = self.word_order[self.word_cut[s] : self.word_cut[s + 1]]
        p = self.pair_order[self.pair_cut[s] : self.pair_cut[s + 1]]
        if not len(w) and not len(p):
            return None
        contexts, sizes = np.unique(self.context[p], return_counts=True)
        fp = self.successor[p]
        low, top = (fp & U64(0xFFFFFFFF)).astype(np.uint32), (fp >> U64(32)).astype(np.uint8)
        return self.words[w].tobytes(), packed(self.counts[w]), self.words[contexts].tobytes(), packed(sizes.astype(np.uint32)), low.tobytes(), top.tobytes(), packed(self.pair_counts[p])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose crc32(id as text) mod folds is held_fold are held out from training. A null text is its end alone; a
    row with a null id is trained on. Without training tokens N = V = 0.
    """
    spark = docs.sparkSession
    held = F.crc32(F.col(id_col).cast("string")) % folds == held_fold
    blocks = staged(blocks_of(docs, id_col, text_col, held), "blocks")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([sum(n)], pa.int64())], names=["n"])

    total = blocks.select("sizes").mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * parts, -(-total // SHARD_GRAMS))
    share = 1 / (HOT * shards)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                words, counts = np.frombuffer(words.as_py(), dtype=np.uint64), unpacked(counts.as_py(), np.uint32)
                top = counts > share * counts.sum()
                yield pa.RecordBatch.from_arrays([pa.array(words[top].view(np.int64)), pa.array(counts[top].astype(np.int64))], names=["word", "n"])

    # a word of more than this share of all tokens has it in some block; each block names at most 1 / share words
    named = blocks.select("words", "counts").mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    hot_words = np.array([r["word"] for r in named.filter(F.col("n") > share * total / 4).select("word").orderBy(F.desc("n")).limit(4 * HOT * shards).collect()], dtype=np.int64).view(np.uint64)

    def hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                words, counts = np.frombuffer(words.as_py(), dtype=np.uint64), unpacked(counts.as_py(), np.uint32)
                top = np.isin(words, hot_words)
                yield pa.RecordBatch.from_arrays([pa.array(words[top].view(np.int64)), pa.array(counts[top].astype(np.int64))], names=["word", "n"])

    counted = {r["word"] % (1 << 64): r["n"] for r in blocks.select("words", "counts").mapInArrow(hot_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    hot = np.array(sorted(counted), dtype=np.uint64)
    hot_totals = np.array([counted[w] for w in hot.tolist()], dtype=np.int64)

    columns = ["shard", "block", "words", "counts", "contexts", "sizes", "low", "top", "pair_counts"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["words"], row["counts"], row["ids"], row["sizes"], row["held"], shards, hot)
                for s in range(shards):
                    if (m := block.message(s)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([row["block"]], pa.int64()), *(pa.array([x], pa.binary()) for x in m)], names=columns)

    messages = blocks.mapInArrow(send, "shard int, block long, " + ", ".join(f"{c} binary" for c in columns[2:]))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        # level 1
        asked = [np.frombuffer(x, dtype=np.uint64) for x in pdf["words"]]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([unpacked(x, np.uint32) for x in pdf["counts"]]), minlength=len(words)).astype(np.int64)
        ends = np.cumsum([len(x) for x in asked])
        word_counts = [packed(x) for x in np.split(counts[at], ends[:-1])]
        # level 2
        contexts = [np.frombuffer(x, dtype=np.uint64) for x in pdf["contexts"]]
        sizes = [unpacked(x, np.uint32).astype(np.int64) for x in pdf["sizes"]]
        after = [np.frombuffer(a, dtype=np.uint32).astype(np.uint64) | (np.frombuffer(b, dtype=np.uint8).astype(np.uint64) << U64(32)) for a, b in zip(pdf["low"], pdf["top"], strict=True)]
        known, rank = np.unique(np.concatenate(contexts), return_inverse=True)
        key = (np.repeat(rank.astype(np.uint64), np.concatenate(sizes)) << U64(FP_BITS)) | np.concatenate(after)
        grams, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([unpacked(x, np.uint32) for x in pdf["pair_counts"]]), minlength=len(grams)).astype(np.int64)
        totals = np.bincount((grams >> U64(FP_BITS)).astype(np.int64), weights=n, minlength=len(known))
        if len(hot):
            place = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
            totals = np.where(hot[place] == known, hot_totals[place], totals)
        seen = n > 0
        trie = Trie(known, totals, grams[seen], n[seen])
        found = [trie.query(c, s, a) for c, s, a in zip(contexts, sizes, after, strict=True)]
        return pd.DataFrame({"shard": pdf["shard"], "block": pdf["block"], "counts": word_counts, "backoff": [packed(b) for b, _ in found], "codes": [packed(a) for _, a in found], "vocabulary": np.where(np.arange(len(pdf)) == 0, int((counts > 0).sum()), 0), "tokens": np.where(np.arange(len(pdf)) == 0, int(counts.sum()), 0)})

    answers = staged(messages.groupBy("shard").applyInPandas(answer, "shard int, block long, counts binary, backoff binary, codes binary, vocabulary long, tokens long"), "answers")
    sums = answers.agg(F.sum("vocabulary"), F.sum("tokens")).first()
    vocabulary, train_tokens = sums[0] or 0, sums[1] or 0

    def score(key: tuple, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        replies = replies.set_index("shard")
        for row in rows.itertuples():
            block = Block(row.words, row.counts, row.ids, row.sizes, row.held, shards, hot)
            counts = np.zeros(len(block.words), dtype=np.int64)
            a, b = np.zeros(len(block.pairs)), np.zeros(len(block.pairs))
            for s, reply in replies.iterrows():
                counts[block.word_order[block.word_cut[s] : block.word_cut[s + 1]]] = unpacked(reply["counts"], np.int64)
                p = block.pair_order[block.pair_cut[s] : block.pair_cut[s + 1]]
                if len(p):
                    a[p] = decoded(unpacked(reply["codes"], np.uint16))
                    _, n = np.unique(block.context[p], return_counts=True)
                    b[p] = np.repeat(decoded(unpacked(reply["backoff"], np.uint16)), n)
            unigram = (counts + 0.5) / (train_tokens + 0.5 * (vocabulary + 1))
            base = np.log10(unigram)[block.ids]
            best = base.copy()
            best[block.inner] = np.log10(a + b * unigram[block.pairs & 0xFFFFFFFF])[block.inverse]
            first = np.cumsum(block.sizes) - block.sizes
            out.append(
                pd.DataFrame(
                    {
                        id_col: pd.arrays.IntegerArray(np.array(row.doc_ids, dtype=np.int64), ~np.array(row.named, dtype=bool)),
                        "held_out": row.held,
                        "n_tokens": block.sizes,
                        "n_known": np.add.reduceat((counts > 0)[block.ids].astype(np.int64), first),
                        "train_tokens": train_tokens,
                        "base_score": np.add.reduceat(base, first),
                        "score": np.add.reduceat(best, first),
                    }
                )
            )
        return pd.concat(out)

    joined = blocks.groupBy("block").cogroup(answers.select("shard", "block", "counts", "backoff", "codes").groupBy("block"))
    return joined.applyInPandas(score, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
