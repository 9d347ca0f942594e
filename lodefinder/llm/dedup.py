"""Near-duplicates by SuperMinHash: signatures, banding, verification on full sets, grouping by union-find.

1. A map over the texts makes each one's set of shingle hashes, a hash of the whole set and the bands of its
   SuperMinHash signature (Ertl 2017: each element draws a random permutation of the slots and one rank for each,
   so slots of one signature are correlated and estimates vary less; ranks are drawn level by level and drawing
   stops once no slot can get lower). Texts with equal sets become one class, named by its smallest id.
2. Classes that share a band's bucket are candidates. In each bucket every class is paired with one pivot, not with
   every other, so pairs grow with the rows of a bucket and not with their square. Pairs are verified on full sets.
3. Links are grouped by union-find within partitions and by star contraction across them. What matters is the
   grouping, so a bucket whose classes now lie in one group is done. The others ("mixed") get further pivots while
   these find links.
4. What is still mixed is settled in tasks: the rows of a bucket that are not of its largest group meet all its rows,
   block by block, so no task holds more than two blocks of signatures and sets. A pair of different groups is
   verified in the first bucket that it shares, so once, if its sizes and signatures allow the similarity. A link joins
   its groups within the block from then on, and only the links that do so leave the task: of two blocks fewer than
   they have rows. No pair that shares a bucket goes unchecked, unless its classes are in one group already or too far
   apart: pairs whose sizes rule out the similarity are left out, and those whose signatures differ by six standard
   deviations more than a pair of similarity 0.75 does (1 in 10^9 by the binomial distribution; SuperMinHash varies
   less): in more than FAR of the lowest bits, or agree in less than AGREE of the low bytes of all slots.

With BANDS bands of ROWS slots two sets of similarity 0.75 share no bucket with a probability of 1.3e-6.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.llm.common import drop_staged, map_text, staged, tune

BANDS, ROWS, SHINGLE = 50, 5, 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rounds of further pivots at most, and rows and shingles of a block of a bucket that is still mixed then. None changes the groups.
PIVOT_ROUNDS, BLOCK, BLOCK_SHINGLES = 1, 1024, 1 << 19
#: At similarity 0.75 an eighth of 250 bits differ, 31 with a deviation of 5.2; of 250 slots 188 agree, with one of 6.9.
FAR, AGREE = 63, 146
#: 64-bit numbers that hold a bit of each slot.
WORDS = -(-BANDS * ROWS // 64)
#: Bands of sketches that are compared without their sets: of similarity 0.75, 1 pair in 900 shares no bucket.
SKETCH_BANDS = 25
#: Edges for each task of a union-find pass.
EDGES = 1 << 18
CACHE_SIZE = 200_000
U64 = np.uint64
UNSET = np.uint32(0xFFFFFFFF)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_SIZE:
            self.clear()
        self[word] = h
        return h


_WORDS = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, A-Z lower-cased; of fewer words, the one of all of them."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    n = max(1, len(words) - size + 1)
    made = np.full(n, min(size, len(words)), dtype=np.uint64)
    for i in range(min(size, len(words))):
        made = made * U64(0x9E3779B97F4A7C15) + hashed[i : i + n]
        made ^= made >> U64(32)
    return np.unique(mix(made))


def super_minhash(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures, a row for each set; an empty set's row is all UNSET.

    A slot's value is level << 24 | rank: at level j an element's permutation gives it one more slot, with a new
    rank. Values of a level are above all values of earlier ones, so a set whose slots are all taken is done.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full(len(sets) * slots, UNSET, dtype=np.uint32)
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    drawn: list[np.ndarray] = []  # the slots swapped at earlier levels, of elements still drawing
    perms = None
    for level in range(slots):
        if not len(element):
            break
        h = mix(element + U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank = (h >> U64(40)).astype(np.uint32)
        pick = (((h & U64(0xFFFFFFFF)) * U64(slots - level)) >> U64(32)).astype(np.int64) + level
        if level == 12:  # few sets draw for so long: from now on their permutations are kept whole
            perms = np.tile(np.arange(slots, dtype=np.int32), (len(element), 1))
            rows = np.arange(len(element))
            for j, k in enumerate(drawn):
                perms[rows, j], perms[rows, k] = perms[rows, k], perms[rows, j].copy()
        if perms is None:
            slot = pick
            for j in range(level - 1, -1, -1):
                slot = np.where(drawn[j] == slot, j, slot)
            drawn.append(pick)
        else:
            rows = np.arange(len(element))
            slot = perms[rows, pick]
            perms[rows, pick] = perms[rows, level]
            perms[rows, level] = slot
        np.minimum.at(out, owner * slots + slot, (U64(level) << U64(24)).astype(np.uint32) | rank)
        going = np.unique(owner)
        open_sets = np.zeros(len(sets), dtype=bool)
        open_sets[going] = (out.reshape(-1, slots)[going] == UNSET).any(axis=1)
        keep = open_sets[owner]
        if not keep.all():
            element, owner = element[keep], owner[keep]
            drawn = [d[keep] for d in drawn] if perms is None else drawn
            perms = perms[keep] if perms is not None else None
    return out.reshape(len(sets), slots)


def bands_of(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band; the band's number is part of it."""
    made = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    for i in range(rows):
        made = mix(made * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return made.view(np.int64)


def bits_of(signatures: np.ndarray) -> np.ndarray:
    """The lowest bit of each slot, packed into 64-bit numbers."""
    packed = np.packbits((signatures & 1).astype(bool), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)


def sketch_of(texts: list[str | None], bands: int = SKETCH_BANDS) -> list:
    """For each text: how many shingles it has, its buckets (none without shingles), the lowest bytes of its slots."""
    n, buckets, slots = [], [], []
    for lo in range(0, len(texts), 250):
        sets = [shingle_set(x) for x in texts[lo : lo + 250]]
        made = super_minhash(sets, bands * ROWS)
        n += [len(s) for s in sets]
        buckets += [b if len(s) else [] for s, b in zip(sets, bands_of(made, bands), strict=True)]
        slots += [x.tobytes() for x in made.astype(np.uint8)]
    return [n, buckets, slots]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, key, bands): key is a 128-bit hash of the set, null for an empty one, which has no bands."""

    def start():
        def compute(texts):
            n, keys, flat, ends = [], [], [], [0]
            for lo in range(0, len(texts), 250):
                sets = [shingle_set(x) for x in texts[lo : lo + 250]]
                made = bands_of(super_minhash(sets))
                n += [len(s) for s in sets]
                keys += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                full = np.array([len(s) > 0 for s in sets], dtype=bool)
                flat.append(made[full].ravel())
                ends += list(ends[-1] + np.cumsum(full) * BANDS)
            return [n, keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))]

        return compute

    return map_text(docs, text_col, [id_col], [("n_shingles", T.LongType()), ("key", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))], start)


def whole_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, variant, n, set, slots, bands, bits0 ...): the sets of texts; lowest bytes and lowest bits of their signatures' slots."""

    def start():
        def compute(texts):
            out = [[] for _ in range(5)]
            for lo in range(0, len(texts), 250):
                sets = [shingle_set(x) for x in texts[lo : lo + 250]]
                signatures = super_minhash(sets)
                made = ([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets], [x.tobytes() for x in signatures.astype(np.uint8)], list(bands_of(signatures)), list(bits_of(signatures)))
                for column, part in zip(out, made, strict=True):
                    column += part
            return out

        return compute

    longs = T.ArrayType(T.LongType())
    made = map_text(docs, text_col, [id_col], [("key", T.BinaryType()), ("set", longs), ("slots", T.BinaryType()), ("bands", longs), ("bits", longs)], start)
    return made.select(id_col, F.xxhash64("key").alias("variant"), F.size("set").alias("n"), "set", "slots", "bands", *(F.col("bits")[i].alias(f"bits{i}") for i in range(WORDS)))


def contract(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: its edges become links of each node to the smallest of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        for lo in range(0, len(pairs), 100_000):
            part = pairs[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node it can reach.

    Rounds of union-find within partitions, then large-star and small-star steps across them (Kiveris et al. 2014),
    until every node points to its smallest only; each round's edges are written to the shared folder. Partitions hold
    about EDGES edges each, so few edges need few tasks, and those of one partition are settled by its union-find
    alone. edges are counted first and should be a staged table.
    """

    def star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """links (u, v): with each, the smallest of u and its neighbours."""
        low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return links.join(low, "u"), low

    def unsettled(links: DataFrame) -> DataFrame:
        """Nodes that point to two others, or point to one and are pointed to."""
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR (out = 1 AND into = 1)")

    parts = -(-edges.count() // EDGES)
    if not parts:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    now = staged(contract(edges.coalesce(parts)), "links")
    while parts > 1 and not unsettled(now).isEmpty():
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large, _ = star(both)
        large = large.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        small, low = star(down)
        small = small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, now = now, staged(contract(small.filter("a <> b").distinct().coalesce(parts)), "links")
        drop_staged(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def one_each(found: DataFrame) -> DataFrame:
    """Of the candidates (rep, pivot_rep) of a round one pair (a, b) for each rep, that with the smallest pivot.

    Mostly it links rep to its group, and then the rep's other candidates are settled without a look at their sets;
    where it does not, their buckets stay mixed and come up again.
    """
    chosen = found.groupBy("rep").agg(F.min("pivot_rep").alias("pivot_rep"))
    return chosen.select(F.least("rep", "pivot_rep").alias("a"), F.greatest("rep", "pivot_rep").alias("b")).distinct()


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def links_in_block(rest: dict[str, np.ndarray], rows: dict[str, np.ndarray], bucket: int, percent: int) -> list[tuple[int, int]]:
    """Links of rows of rest with rows of other groups, verified where this bucket is the pair's first common one.

    rows: their sets lie in a row in "flat", from "first" on, "n" shingles each. Groups that a link joins are one from
    then on, so pairs within it are not looked at and there are fewer links than groups: a spanning forest of them.
    Without sets, the share of slots that agree decides.
    """
    exact = "flat" in rows
    found, band = [], int(np.argmax(rows["bands"][0] == bucket)) if exact and len(rows["rep"]) else 0
    named, groups = np.unique(np.concatenate([rest["component"], rows["component"]]), return_inverse=True)
    asking, asked = np.split(groups, [len(rest["rep"])])

    def link(at: int, linked: np.ndarray) -> None:
        """One link of row at of rest to each of the groups that hold linked rows; these groups become one."""
        joined, one = np.unique(asked[linked], return_index=True)
        found.extend((int(rest["rep"][at]), int(rows["rep"][q])) for q in linked[one])
        to = np.arange(len(named))
        to[joined] = asking[at]
        asking[:], asked[:] = to[asking], to[asked]

    for lo in range(0, len(rest["rep"]), 64):
        x = {k: v[lo : lo + 64] for k, v in rest.items() if k != "flat"}
        n, m = x["n"][:, None], rows["n"][None, :]
        may = (asking[lo : lo + 64, None] != asked[None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        may &= ~rows["rest"][None, :] | (x["rep"][:, None] < rows["rep"][None, :])  # two of the rest meet twice
        for i in np.flatnonzero(may.any(axis=1)):
            j = np.flatnonzero(may[i] & (asked != asking[lo + i]))
            if not exact:
                j = j[100 * (x["slots"][i] == rows["slots"][j]).sum(axis=1, dtype=np.int32) >= percent * rows["slots"].shape[1]]
                if len(j):
                    link(lo + i, j)
                continue
            j = j[np.bitwise_count(x["bits"][i] ^ rows["bits"][j]).sum(axis=1, dtype=np.int32) <= FAR]
            j = j[(x["slots"][i] == rows["slots"][j]).sum(axis=1, dtype=np.int32) >= AGREE]
            j = j[np.argmax(x["bands"][i] == rows["bands"][j], axis=1) == band]
            own = rest["flat"][x["first"][i] : x["first"][i] + x["n"][i]]
            for part in np.array_split(j, -(-int(rows["n"][j].sum()) // 1_000_000) or 1):
                part = part[asked[part] != asking[lo + i]]
                if not len(part):
                    continue
                size = rows["n"][part]
                begin = np.cumsum(size) - size
                theirs = rows["flat"][np.arange(size.sum()) + np.repeat(rows["first"][part] - begin, size)]
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                common = np.add.reduceat((own[at] == theirs).astype(np.int64), begin)
                if len(hit := part[100 * common >= percent * (len(own) + size - common)]):
                    link(lo + i, hit)
    return found


def links_of_mixed(rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), verified, among rows (bucket, rep, component, n, variant) of mixed buckets.

    whole: (rep, variant, set, slots, bands), or (rep, variant, slots) where slots alone decide.
    """
    exact = "set" in whole.columns
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n")).groupBy("bucket")
    sizes = sizes.agg(F.max_by("component", F.struct("k", "component")).alias("home"), F.sum("k").alias("all_k"), F.sum("n").alias("all_n"), F.max(F.struct("k", "component", "n")).alias("h"))
    blocks = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("bucket", "home", blocks(F.col("all_k"), F.col("all_n")).alias("blocks"), blocks(F.col("all_k") - F.col("h.k"), F.col("all_n") - F.col("h.n")).alias("rest_blocks"))
    dealt = rows.join(sizes.filter("rest_blocks > 0"), "bucket").withColumn("rest", F.col("component") != F.col("home")).withColumn("deal", F.xxhash64("rep", "variant"))
    row_of, column_of = F.pmod("deal", "rest_blocks").cast("int"), F.pmod("deal", "blocks").cast("int")

    def place(asks: bool, i: F.Column, j: F.Column) -> F.Column:
        return F.struct(F.lit(asks).alias("asks"), i.alias("i"), j.alias("j"))

    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: place(True, row_of, j))
    asked = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda i: place(False, i, column_of))
    dealt = dealt.withColumn("place", F.explode(F.when(F.col("rest"), F.concat(asking, asked)).otherwise(asked)))
    dealt = dealt.select("bucket", "place.i", "place.j", "place.asks", "rest", "component", "n", "rep", "variant").join(whole, ["rep", "variant"])
    dealt = dealt.drop("variant").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        got = {c: table.column(c).to_numpy() for c in ("bucket", "rep", "component", "n", "rest", "asks")}
        got["slots"] = np.frombuffer(b"".join(table.column("slots").to_pylist()), dtype=np.uint8).reshape(len(table), -1)
        if exact:
            got["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
            got["bits"] = bits_of(got["slots"]).view(np.uint64)
        got["first"] = np.cumsum(got["n"], dtype=np.int64) - got["n"]
        return got

    def groups(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        got, found = columns(table), []
        sets = {"flat": table.column("set").combine_chunks().flatten().to_numpy().view(np.uint64)} if exact else {}
        for lo, hi in zip(cuts, [*cuts[1:], len(table)], strict=True):
            part = {k: v[lo:hi] for k, v in got.items()}
            asks = part["asks"]
            found += links_in_block({k: v[asks] for k, v in part.items()} | sets, {k: v[~asks] for k, v in part.items()} | sets, part["bucket"][0], percent)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def key_at(table: pa.Table, i: int) -> tuple:
        return tuple(table.column(c)[i].as_py() for c in ("bucket", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group's rows may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch])
            last = key_at(table, len(table) - 1)
            low, high = 0, len(table) - 1
            while low < high:  # where the last group begins
                mid = (low + high) // 2
                low, high = (low, mid) if key_at(table, mid) == last else (mid + 1, high)
            if low:
                yield groups(table.slice(0, low).combine_chunks())
            held = table.slice(low).combine_chunks().to_batches()
        if held:
            yield groups(pa.Table.from_batches(held))

    tune(rows.sparkSession)
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def agreeing(pairs: DataFrame, slots: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which enough slots agree; slots: (rep, slots)."""
    both = pairs.join(slots.select(F.col("rep").alias("a"), F.col("slots").alias("slots_a")), "a").join(slots.select(F.col("rep").alias("b"), F.col("slots").alias("slots_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(len(batch), -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(100 * (x == y).sum(axis=1) >= percent * x.shape[1]))

    return both.select("a", "b", "slots_a", "slots_b").mapInArrow(run, "a long, b long")


def sketch_groups(sketched: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) by sketches alone: for counts of distinct documents, which bear an estimate of similarity.

    sketched: (id, n, bands, slots) of documents, whose repeated ids have one text; known: a staged table of edges
    (a, b) that hold anyway. The steps are those of near_duplicates, but the share of slots that agree stands for the
    similarity (its deviation is below 0.04), so neither texts nor sets are shuffled or written. Nodes without any
    link may be absent.
    """
    rows = sketched.select(F.explode("bands").alias("bucket"), F.col("id").alias("rep")).distinct()
    ranges = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    shared = staged(rows.join(ranges.select("bucket"), "bucket", "left_semi"), "shared")
    slots = sketched.select(F.col("id").alias("rep"), F.col("n").cast("long").alias("n"), "slots").join(shared.select("rep").distinct(), "rep", "left_semi")
    slots = staged(slots.dropDuplicates(["rep"]), "slots")
    groups = components(known)
    for step in range(PIVOT_ROUNDS + 2):
        held = shared.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        order = F.col("rep") if step == 0 else F.xxhash64("rep", F.lit(step))
        mixed = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(order.alias("order"), "rep", "component")).alias("p")).filter("low < high")
        last = step == PIVOT_ROUNDS + 1
        if not last:
            pivots = mixed.select("bucket", F.col("p.rep").alias("pivot_rep"), F.col("p.component").alias("pivot_component"))
            found = staged(agreeing(one_each(held.join(pivots, "bucket").filter("component <> pivot_component")), slots, percent), "links")
            last = found.isEmpty()
        if last:
            open_rows = held.join(mixed.select("bucket"), "bucket", "left_semi").join(slots.select("rep", "n"), "rep").select("bucket", "rep", "component", "n", F.lit(0).alias("variant"))
            open_rows = staged(open_rows, "mixed")
            found = staged(links_of_mixed(open_rows, slots.select("rep", F.lit(0).alias("variant"), "slots"), percent), "links")
            drop_staged(open_rows)
        if not found.isEmpty():
            groups = components(groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
        drop_staged(found)
        if last:
            drop_staged(shared, slots)
            return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Rows with one id are one document. Texts that are null, empty or without words have no shingles and no links:
    component_id is their own id. A null id takes no part in links and has a null component.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = staged(sketches(texts, "id", "text"), "sketches")
    named = base.filter("id IS NOT NULL AND key IS NOT NULL")
    classes = named.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    # nodes are the smallest ids of classes; the texts of a repeated id are variants, of one node
    variant = F.xxhash64("key").alias("variant")
    reps = named.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key", "id"])
    reps = staged(reps.select(F.col("id").alias("rep"), variant, "bands"), "classes")
    rows = reps.select(F.explode("bands").alias("bucket"), "variant")
    ranges = rows.groupBy("bucket").agg(F.min("variant").alias("low"), F.max("variant").alias("high")).filter("low < high")
    shared = staged(rows.join(ranges.select("bucket"), "bucket", "left_semi"), "shared")

    asked = reps.select("rep", "variant").join(shared.select("variant").distinct(), "variant", "left_semi").select(F.col("rep").alias("id")).distinct()
    sets = whole_sets(texts.join(asked, "id", "left_semi"), "id", "text")
    repeated = named.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").limit(1)
    sets = staged(sets if repeated.isEmpty() else sets.dropDuplicates(["id", "variant"]), "sets")
    marks = ["n", "variant", *(f"bits{i}" for i in range(WORDS))]
    buckets, shared = shared, staged(shared.join(sets.select(F.col("id").alias("rep"), *marks), "variant"), "shared")
    drop_staged(buckets, reps)

    def near(other: str) -> F.Column:
        """What a pair must meet to be verified, by the columns of one and those of the other, which begin with other."""
        differ = sum((F.bit_count(F.col(f"bits{i}").bitwiseXOR(F.col(f"{other}bits{i}"))) for i in range(WORDS)), F.lit(0))
        return (100 * F.least("n", f"{other}n") >= percent * F.greatest("n", f"{other}n")) & (differ <= FAR)

    # rows with one id but different texts are one node: nothing to link, as their classes carry the same name
    own = classes.filter("rep < last").select("key", "rep")
    members = named.join(own, "key").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    groups = components(members.limit(0) if repeated.isEmpty() else staged(members, "members"))

    for step in range(PIVOT_ROUNDS + 2):
        held = shared.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        order = F.col("rep") if step == 0 else F.xxhash64("rep", F.lit(step))
        pivot = F.min(F.struct(order.alias("order"), "rep", "component", *marks)).alias("p")
        mixed = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), pivot).filter("low < high")
        last = step == PIVOT_ROUNDS + 1
        if not last:
            pivots = mixed.select("bucket", *(F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("rep", "component", *marks)))
            more = one_each(held.join(pivots, "bucket").filter("component <> pivot_component").filter(near("pivot_")))
            found = staged(links_of(more, sets, percent), "links")
            last = found.isEmpty()
        if last:
            open_rows = held.join(mixed.select("bucket"), "bucket", "left_semi").select("bucket", "rep", "component", "n", "variant")
            whole = sets.select(F.col("id").alias("rep"), "variant", "set", "slots", "bands")
            open_rows = staged(open_rows, "mixed")
            found = staged(links_of_mixed(open_rows, whole, percent), "links")
            drop_staged(open_rows)
        if not found.isEmpty():
            groups = components(groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
        drop_staged(found)
        if last:
            break
    drop_staged(shared, sets)  # what is returned reads the sketches and the groups
    named_groups = classes.select("key", "rep").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = base.select("id", "n_shingles", "key").join(named_groups, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))
