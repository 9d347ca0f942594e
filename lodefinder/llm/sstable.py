"""Token ids in sorted string tables: files of documents keyed by identifier, for binary-search lookup.

A table is a folder of files, ordered by a number in their footers; keys ascend within a file and from file to
file. A file is, in this order (all integers little-endian but in keys):

* data blocks: zstd-compressed runs of entries. An entry is u16 shared, u16 unshared, u32 value size, the unshared
  end of the key, the value; shared is how many leading bytes its key has in common with the key before it in the
  block. A key is 00 for a null id, or 01 and the id as 8 big-endian bytes with the sign bit flipped, so bytes sort
  as ids do. A value is the token ids, in u16 or u32 as the footer says.
* the sparse index: for each block u16 key size, its last key, u64 offset, u32 size;
* a Bloom filter over the keys: u32 bits, u8 probes, the bits;
* the footer (FOOTER below): where index and filter lie, entries, token ids, file number, id width, magic.

Each part is one row of a DataFrame that Spark's text sink writes, so a line feed follows each; offsets count it.
The files go through Spark's own commit protocol to whatever store the path names, and come back by its binary
source; a lost executor's tasks write theirs again.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from lodefinder.llm.common import fresh_path, tune
from lodefinder.llm.tokens import LETTERS, NUMBERS, SPACES, UNSAFE

BLOCK_BYTES, BLOOM_BITS, BLOOM_PROBES, CACHE_SIZE = 1 << 18, 10, 7, 1_000_000
FOOTER = struct.Struct("<QIQIQQIB8s")
MAGIC = b"TOKSST01"
ENTRY = struct.Struct("<HHI")
PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class Ids(dict):
    """Token ids of each pre-token as little-endian unsigned 32-bit integers, kept up to CACHE_SIZE entries."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")

    def of_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.of_library(word)
        if len(word) <= 64:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if UNSAFE.search(text) or self.special.search(text):
            return self.of_library(text)
        return b"".join(map(self.__getitem__, PATTERN.findall(text)))


_IDS: dict[str, Ids] = {}


def ids_of(name: str) -> Ids:
    if name not in _IDS:
        _IDS[name] = Ids(Tokenizer.from_file(public_tokenizers.path(name)))
    return _IDS[name]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[:1] == b"\1" else None


def probes(key: bytes, bits: int, count: int) -> list[int]:
    a, b = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, seed=1) | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(count)]


class FileWriter:
    """Parts of one file, each to be followed by a line feed."""

    def __init__(self, number: int, width: int) -> None:
        self.number, self.width = number, width
        self.offset = self.entries = self.tokens = 0
        self.block, self.size, self.last = [], 0, b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def part(self, data: bytes) -> tuple[bytes, int]:
        at = self.offset
        self.offset += len(data) + 1
        return data, at

    def close_block(self) -> Iterator[bytes]:
        if self.block:
            data, at = self.part(zstandard.compress(b"".join(self.block), 1))
            self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QI", at, len(data)))
            self.block, self.size, self.last = [], 0, b""
            yield data

    def add(self, key: bytes, ids: np.ndarray) -> Iterator[bytes]:
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block.append(ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value)
        self.size += len(value) + 16
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.tokens += len(ids)
        if self.size >= BLOCK_BYTES:
            yield from self.close_block()

    def close(self) -> Iterator[bytes]:
        if not self.entries:
            return
        yield from self.close_block()
        index, index_at = self.part(b"".join(self.index))
        yield index
        bits = -(-max(64, BLOOM_BITS * len(self.keys)) // 8) * 8
        field = np.zeros(bits, dtype=bool)
        for key in self.keys:
            field[probes(key, bits, BLOOM_PROBES)] = True
        bloom, bloom_at = self.part(struct.pack("<IB", bits, BLOOM_PROBES) + np.packbits(field).tobytes())
        yield bloom
        yield FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.entries, self.tokens, self.number, self.width, MAGIC)


class FileReader:
    """One file's bytes: its footer, all entries in order, or one key by filter, index and block."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        index_at, index_size, bloom_at, bloom_size, self.entries, self.tokens, self.number, self.width, magic = FOOTER.unpack(data[-FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.index, at = [], index_at
        while at < index_at + index_size:
            (n,) = struct.unpack_from("<H", data, at)
            self.index.append((data[at + 2 : at + 2 + n], *struct.unpack_from("<QI", data, at + 2 + n)))
            at += n + 14
        self.bits, self.probes = struct.unpack_from("<IB", data, bloom_at)
        self.bloom = data[bloom_at + 5 : bloom_at + bloom_size]

    def block(self, at: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw, i, key = zstandard.ZstdDecompressor().decompress(self.data[at : at + size]), 0, b""
        while i < len(raw):
            shared, own, n = ENTRY.unpack_from(raw, i)
            i += ENTRY.size
            key = key[:shared] + raw[i : i + own]
            yield key, np.frombuffer(raw, dtype="<u2" if self.width == 2 else "<u4", count=n // self.width, offset=i + own)
            i += own + n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, at, size in self.index:
            yield from self.block(at, size)

    def get(self, key: bytes) -> list[np.ndarray]:
        """Values of a key (several where an id repeats); none costs a look at the filter, seldom a block."""
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in probes(key, self.bits, self.probes)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block whose last key is not below key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for last, at, size in self.index[low:]:
            found += [v.astype("<u4") for k, v in self.block(at, size) if k == key]
            if last > key:
                break
        return found


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode every whole text, append end_id, and write the table in ascending order of id (equal ids: of text hash)."""
    tune(docs.sparkSession)
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col).asc()]
    sorted_docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias(text_col)).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_of(tokenizer)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        file, end = FileWriter(TaskContext.get().partitionId(), width), struct.pack("<I", end_id)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in file.add(key_of(doc_id), np.frombuffer(encoder.encode(text) + end, dtype="<u4")):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["value"])
        for part in file.close():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["value"])

    sorted_docs.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) for every entry; start counts the ids of all entries before it."""
    files = files_of(spark, path)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [FileReader(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.number for f in found], pa.int64()), pa.array([f.tokens for f in found], pa.int64())], names=["file", "tokens"])

    # one row a file: the running sum over them is small
    totals = files.select("content").mapInArrow(footers, "file long, tokens long")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("file", before.alias("file_start"))

    names = ["file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

        for batch in batches:
            for content in batch.column(0):
                file, at, rows = FileReader(content.as_py()), 0, []
                for key, ids in file:
                    rows.append((file.number, id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32)))
                    at += len(ids)
                    if len(rows) == 500:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    read = files.select("content").mapInArrow(entries, "file long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return read.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup_tokens(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the asked identifiers: filter, index and one block of each file, not whole files."""
    keys = sorted({key_of(i) for i in ids})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = FileReader(content.as_py())
                hits = [(id_of(k), v.astype(np.int32)) for k in keys for v in file.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return files_of(spark, path).select("content").mapInArrow(find, "doc_id long, ids array<int>")


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as a token table in the shared folder and returns (doc_id, start, n_tokens, ids_crc32) read from it.

    Null and empty texts have the end id alone; a null id sorts first. An empty table has no files and no rows.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, id_col, text_col)
    return read_tokens(spark, path, with_ids=False).withColumnRenamed("doc_id", id_col)
