"""Merkle trees over a range-sorted RDD, with a proof for every leaf.

Leaves are sorted by group and order into the partitions of a checkpointed RDD. The counts of the first and the last
group of each partition give every partition the place of its leaves within their groups, so that it can build all
complete, aligned subtrees of WIDTH by itself. Only nodes whose run reaches into other partitions leave it: at most
2 * (WIDTH - 1) a level. These are shuffled by coordinate (group, level, run) and finished level by level; then each
gets the siblings from there to the root. A second pass over the sorted partitions, which the boundary nodes' paths
join by partition, puts both halves of each proof together.

A tree over the groups' roots, ordered by group, is built by the same means. The driver sees four numbers and two
digests a partition and no node. A lost executor costs its tasks: sorted leaves and each level are written down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.llm.common import staged, work_dir

#: Children of a node, and leaves of a partition (there are as many partitions as the session shuffles by, at least).
WIDTH, PART_ROWS = 8, 65_536
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field_text(c: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def path_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), 256)


def climb(start: int, hashes: list[str], total: int) -> list[tuple[int, list[str], int]]:
    """(first place, nodes, size of the whole level) of each level that leaves start.. of total can make alone."""
    levels = [(start, hashes, total)]
    while total > 1 and hashes:
        end = start + len(hashes)
        first, last = -(-start // WIDTH), -(-end // WIDTH) if end == total else end // WIDTH
        hashes = [digest("".join(hashes[i * WIDTH - start : (i + 1) * WIDTH - start])) for i in range(first, last)]
        start, total = first, -(-total // WIDTH)
        levels.append((start, hashes, total))
    return levels


def runs_of(rows: list, place: tuple[int, int, int] | None) -> Iterator[tuple[bytes, list, int, int]]:
    """(group, its rows in this partition, place of the first, size of the group) of sorted rows.

    place has the place of the first group's first row and the sizes of the first and of the last group.
    """
    groups = [(g, list(some)) for g, some in groupby(rows, key=lambda r: r[0][0])]
    for i, (g, some) in enumerate(groups):
        total = place[1] if i == 0 else place[2] if i == len(groups) - 1 else len(some)
        yield g, some, place[0] if i == 0 else 0, total


def places(sorted_rows: RDD) -> dict[int, tuple[int, int, int]]:
    """For each partition with rows: see runs_of. From the counts of its first and its last group only."""

    def ends(part: int, rows: Iterator) -> Iterator:
        found = [(hashlib.sha256(g).digest(), sum(1 for _ in some)) for g, some in groupby(rows, key=lambda r: r[0][0])]
        if found:
            yield part, len(found) == 1, found[0], found[-1]

    before, sizes, starts, reports = (b"", 0), {}, {}, sorted(sorted_rows.mapPartitionsWithIndex(ends).collect())
    for part, single, first, last in reports:
        starts[part] = before[1] if before[0] == first[0] else 0
        sizes[first[0]] = sizes.get(first[0], 0) + first[1]
        if not single:
            sizes[last[0]] = sizes.get(last[0], 0) + last[1]
        before = (first[0], starts[part] + first[1]) if single else last
    return {part: (starts[part], sizes[first[0]], sizes[last[0]]) for part, _, first, last in reports}


def proved(nodes: DataFrame, groups_too: bool) -> DataFrame:
    """nodes with subroot, root and proof (array of struct(left, right) from the leaf up).

    nodes has columns g (binary, the group), o (the order within it, null first), hash and any others. The trees of the
    groups have the groups' tree above them if groups_too is set, else each group has a root of its own. Of nodes with
    equal order the smaller hash goes first; which of two equal nodes comes first changes nothing but their places.
    """
    spark = nodes.sparkSession
    context = spark.sparkContext
    work_dir(spark)
    carried = [c for c in nodes.columns if c not in ("g", "o", "hash")]
    schema = T.StructType([nodes.schema[c] for c in ("g", "o", "hash", *carried)] + [T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("proof", PATH)])
    leaves = staged(nodes.select("g", "o", "hash", *carried, F.monotonically_increasing_id().alias("tie")), "leaves")
    count = leaves.count()
    if not count:
        return spark.createDataFrame([], schema)
    zero = b"" if isinstance(nodes.schema["o"].dataType, T.BinaryType) else 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_ROWS))

    def keyed(r) -> tuple:
        o = bytes(r.o) if isinstance(r.o, bytearray) else r.o
        return (bytes(r.g), o is not None, zero if o is None else o, r.hash, r.tie), tuple(r[c] for c in carried)

    ordered = leaves.rdd.map(keyed).sortByKey(numPartitions=parts)
    ordered.checkpoint()
    place = context.broadcast(places(ordered))

    def boundary(part: int, rows: Iterator) -> Iterator:
        """Nodes whose parent this partition can not make, and roots."""
        rows = list(rows)
        if not rows:
            return
        for g, some, start, total in runs_of(rows, place.value[part]):
            levels = climb(start, [r[0][3] for r in some], total)
            for level, (first, hashes, n) in enumerate(levels):
                above, made, _ = levels[level + 1] if level + 1 < len(levels) else (0, [], 0)
                for i, h in enumerate(hashes, first):
                    if not above <= i // WIDTH < above + len(made):
                        yield g, level, n, i, h, part

    edge = staged(spark.createDataFrame(ordered.mapPartitionsWithIndex(boundary), "g binary, level int, n long, i long, hash string, part int"), "boundary")
    height, size = 0, max(max(x[1:]) for x in place.value.values())
    while size > 1:
        height, size = height + 1, -(-size // WIDTH)

    # up: runs of each level by coordinate; a run never has more than WIDTH nodes
    runs, roots, made = [], [], None
    for level in range(height + 1):
        here = edge.filter(F.col("level") == level).select("g", "n", "i", "hash", "part")
        here = here.unionByName(made) if made is not None else here
        roots.append(here.filter("n = 1").select("g", "i", "hash", "part"))
        if level < height:
            met = here.filter("n > 1").groupBy("g", "n", F.floor(F.col("i") / WIDTH).alias("up")).agg(F.array_sort(F.collect_list(F.struct("i", "hash", "part"))).alias("nodes"))
            runs.append(staged(met, "runs"))
            made = runs[-1].select("g", F.ceil(F.col("n") / WIDTH).alias("n"), F.col("up").alias("i"), F.sha2(F.array_join("nodes.hash", ""), 256).alias("hash"), F.lit(None).cast("int").alias("part"))

    tops = roots[0]
    for r in roots[1:]:
        tops = tops.unionByName(r)
    empty = F.array().cast(PATH)
    if groups_too:
        over = proved(tops.select(F.lit(b"").alias("g"), F.col("g").alias("o"), "hash"), False)
        over = staged(over.select(F.col("o").alias("g"), F.col("hash").alias("subroot"), "root", F.col("proof").alias("path")), "groups")
    else:
        over = tops.select("g", F.col("hash").alias("subroot"), F.col("hash").alias("root"), empty.alias("path"))

    # down: each node's siblings and its parent's path
    paths, upper = [], None
    for level in reversed(range(height + 1)):
        here = roots[level].join(over, "g").select("g", "i", "part", "subroot", "root", "path")
        if upper is not None:
            each = runs[level].withColumnRenamed("up", "i").join(upper.select("g", "i", "subroot", "root", "path"), ["g", "i"]).select("g", "subroot", "root", "path", "nodes", F.explode("nodes").alias("x"))
            side = lambda keep: F.array_join(F.transform(F.filter("nodes", keep), lambda y: y["hash"]), "")
            step = F.struct(side(lambda y: y["i"] < F.col("x.i")).alias("left"), side(lambda y: y["i"] > F.col("x.i")).alias("right"))
            here = here.unionByName(each.select("g", "x.i", "x.part", "subroot", "root", F.concat(F.array(step), "path").alias("path")))
        upper = staged(here, "paths")
        paths.append(upper.filter("part IS NOT NULL").withColumn("level", F.lit(level)))
    given = paths[0]
    for p in paths[1:]:
        given = given.unionByName(p)

    # paths go where the leaves are: by the key of any row of that partition, through the partitioner of the sort
    heads = context.broadcast(dict(ordered.mapPartitionsWithIndex(lambda part, rows: [(part, r[0]) for r, _ in zip(rows, range(1), strict=False)]).collect()))
    sent = given.rdd.map(lambda r: (heads.value[r.part], (bytes(r.g), r.level, r.i, r.subroot, r.root, [(s.left, s.right) for s in r.path])))
    sent = sent.map(lambda x: (x[0], ("path", x[1])))
    marked = ordered.mapPartitions(lambda rows: ((k, ("leaf", v)) for k, v in rows), preservesPartitioning=True)
    if ordered.partitioner is not None:
        sent = sent.partitionBy(ordered.getNumPartitions(), ordered.partitioner.partitionFunc)
    both = marked.union(sent)
    if ordered.partitioner is not None:  # no shuffle where the union has kept the partitions, as it does
        both = both.partitionBy(ordered.getNumPartitions(), ordered.partitioner.partitionFunc)

    def prove(part: int, rows: Iterator) -> Iterator:
        mine, found = [], {}
        for key, (kind, value) in rows:
            if kind == "leaf":
                mine.append((key, value))
            else:
                found[value[:3]] = value[3:]
        mine.sort(key=lambda r: r[0])
        if not mine:
            return
        for g, some, start, total in runs_of(mine, place.value[part]):
            levels = climb(start, [r[0][3] for r in some], total)
            known: dict[tuple[int, int], tuple[str, str, list]] = {}

            def path(level: int, i: int) -> tuple[str, str, list]:
                """(subroot, root, siblings from here up) of a node; runs above the leaves are put together once."""
                if (level, i) in known:
                    return known[level, i]
                if (g, level, i) in found:
                    subroot, root, steps = found[g, level, i]
                else:
                    first, hashes, _ = levels[level]
                    at = i // WIDTH * WIDTH
                    subroot, root, above = path(level + 1, i // WIDTH)
                    steps = [("".join(hashes[at - first : i - first]), "".join(hashes[i + 1 - first : at + WIDTH - first])), *above]
                if level:
                    known[level, i] = subroot, root, steps
                return subroot, root, steps

            for i, (key, values) in enumerate(some, start):
                subroot, root, steps = path(0, i)
                yield (g, key[2] if key[1] else None, key[3], *values, subroot, root, steps)

    return spark.createDataFrame(both.mapPartitionsWithIndex(prove), schema, verifySchema=False)


def manifest(docs: DataFrame, id_col: str, group_col: str, fields: list[str], **more: Column) -> DataFrame:
    """One row for each row of docs: the id, the columns more, leaf, subroot, root, proof.

    A leaf is the digest of all fields, each as its byte count, a colon and its value, or '-' where it is null. Groups
    are the values of group_col, null first, then by bytes; within a group leaves ascend by id (an integer), null first,
    then by leaf. Repeated rows are leaves of their own. Names of result columns in docs do no harm: only id_col,
    group_col, fields and what more reads are read. An empty table gives no rows and no root.
    """
    g = F.coalesce(F.concat(F.lit(b"\1"), F.col(group_col).cast("string").cast("binary")), F.lit(b"\0"))
    named = {f"more_{i}": c for i, c in enumerate(more.values())}
    nodes = docs.select(g.alias("g"), F.col(id_col).cast("long").alias("o"), leaf_of(*map(F.col, fields)).alias("hash"), *(c.alias(n) for n, c in named.items()))
    made = proved(nodes, True)
    return made.select(F.col("o").alias(id_col), *(F.col(n).alias(m) for n, m in zip(named, more, strict=True)), F.col("hash").alias("leaf"), "subroot", "root", "proof")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text has been lower-cased, for a third of all ids; for the others the true one."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return leaf_of(*(changed if c == "text" else F.col(c) for c in FIELDS))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents; a null id is never tampered with."""
    made = manifest(docs, "doc_id", "lang", FIELDS, found=tampered(docs))
    out = made.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("found"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
