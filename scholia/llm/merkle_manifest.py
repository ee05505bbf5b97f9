"""Merkle manifest of a dataset: one hash for all rows, a proof for each.

Leaves are hashed by SQL functions, range-sorted by group and id, and packed into chunks of
consecutive leaves.  Chunk counts give every leaf its index in its group, so the shape of
each group's tree is known before any inner node.

A chunk's part of a tree is a sparse forest: the nodes whose parent is not known yet, keyed
by level and index.  Forests of neighbouring chunks form a monoid: their union, in which
every run of siblings that is complete (two nodes, or the one last node of an odd level)
becomes its parent, until none is left.  `reduce_forests` combines `FAN` neighbours at a
time in grouped rounds over written tables (RDD.treeReduce would combine partitions that
are no neighbours, whose forests don't shrink, and would end on the driver).  One node is
left for each group, the root of its tree; the groups' roots are the leaves of one more
tree of the same kind.

A chunk's leaves need at most four nodes of each level from outside.  The chunk asks for them
by (group, level, index) in an equi-join with all nodes that left their chunk.

Defined results: null fields enter a leaf as `-`; a null group comes first and is a group of
its own; null ids come before others; rows of one id are ordered by their leaf, and repeated
rows are separate leaves; a very long text is hashed whole; a lone leaf is its group's root,
and its proof is the hash of nothing if its group is alone too; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

#: Leaves of a chunk, and neighbouring forests that one step combines.
CHUNK = 1024
FAN = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_CHUNKS = "part int, seq int, grp string, n int, names array<string>, leaves binary, others binary"
_NODES = "grp string, no long, level int, idx long, hash string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of fields, each as its byte count, `:` and value, or `-`."""
    coded = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*coded), 256)


def level_sizes(count: int) -> list[int]:
    """Nodes on each level of a tree, from its leaves to its root."""
    sizes = [count]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    return sizes


def parent(nodes: dict[tuple[int, int], str], sizes: list[int], level: int, idx: int) -> str | None:
    """The hash of a node from its children, if all of them are there."""
    left = nodes.get((level - 1, 2 * idx))
    if 2 * idx + 1 >= sizes[level - 1]:
        return left and digest(left)
    right = nodes.get((level - 1, 2 * idx + 1))
    return digest(left, right) if left and right else None


def combine(nodes: dict[tuple[int, int], str], sizes: list[int]) -> tuple[dict[tuple[int, int], str], set[tuple[int, int]]]:
    """Parents of all complete sibling runs, and the nodes of the forest that have no parent yet."""
    made: dict[tuple[int, int], str] = {}
    known, left = dict(nodes), set(nodes)
    todo = sorted(nodes)
    while todo:
        above = []
        for level, idx in todo:
            up = (level + 1, idx // 2)
            if up[0] < len(sizes) and up not in known and (h := parent(known, sizes, *up)):
                known[up] = made[up] = h
                left.add(up)
                above.append(up)
                left -= {(level, up[1] * 2), (level, up[1] * 2 + 1)}
        todo = above
    return made, left


def chunk_forest(leaves: list[str], start: int, sizes: list[int]) -> list[dict[int, str]]:
    """All nodes that a chunk of consecutive leaves gives alone: {index: hash} for each level."""
    levels = [{start + i: h for i, h in enumerate(leaves)}]
    for level in range(1, len(sizes)):
        below, row = levels[-1], {}
        for idx in {i // 2 for i in below}:
            left, last = below.get(2 * idx), 2 * idx + 1 >= sizes[level - 1]
            if left and last:
                row[idx] = digest(left)
            elif left and (right := below.get(2 * idx + 1)):
                row[idx] = digest(left, right)
        if not row:
            break
        levels.append(row)
    return levels


def outside(levels: list[dict[int, str]], start: int, n: int, sizes: list[int]) -> list[tuple[int, int]]:
    """(level, index) of the siblings on the paths of a chunk's leaves that it lacks."""
    asked = []
    for level in range(len(sizes) - 1):
        own = levels[level] if level < len(levels) else {}
        first, last = start >> level, (start + n - 1) >> level
        near = range(first, last + 1) if last - first < 4 else (first, first + 1, last - 1, last)
        asked += [(level, s) for s in {i ^ 1 for i in near} if s < sizes[level] and s not in own]
    return asked


def _hex(blob: bytes) -> list[str]:
    text = blob.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _chunks(leaves: DataFrame, size: int) -> DataFrame:
    """Consecutive leaves (grp, id, leaf, other) of one group, `size` at most to a row, in global order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            cols = (
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held[0][0]]), pa.array([len(held)], pa.int32()),
                pa.array([[r[1] for r in held]], pa.list_(pa.string())),
                pa.array([bytes.fromhex("".join(r[2] for r in held))]), pa.array([bytes.fromhex("".join(r[3] for r in held))]))
            return pa.RecordBatch.from_arrays(list(cols), names=["part", "seq", "grp", "n", "names", "leaves", "others"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == size or held[-1][0] != r[0]):
                    yield row()
                    seq, held = seq + 1, []
                held.append(r)
        if held:
            yield row()

    order = ["grp", F.col("id").asc_nulls_first(), "leaf"]
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("grp", F.col("id").cast("string"), "leaf", "other").mapInArrow(pack, _CHUNKS)


def _numbered(chunks: DataFrame) -> DataFrame:
    """Rows (part, seq, grp, n, start, no, total): each chunk's first leaf, its number and the leaves of its group."""
    meta = chunks.select("part", "seq", "grp", "n")
    zero = F.lit(0).cast("long")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), zero)
    parts = meta.groupBy("grp", "part").agg(F.sum("n").alias("part_n"), F.count("*").alias("part_chunks"))
    by_part, group = W.partitionBy("grp").orderBy("part"), W.partitionBy("grp")
    parts = parts.select("grp", "part", before("part_n", by_part).alias("n0"), before("part_chunks", by_part).alias("c0"), F.sum("part_n").over(group).alias("total"))
    inside = W.partitionBy("grp", "part").orderBy("seq")
    rows = meta.withColumns({"n1": before("n", inside), "c1": F.row_number().over(inside) - 1})
    return rows.join(parts, ["grp", "part"]).select("part", "seq", "grp", "n", (F.col("n0") + F.col("n1")).alias("start"), (F.col("c0") + F.col("c1")).cast("long").alias("no"), "total")


def _forests(chunks: DataFrame) -> DataFrame:
    """Each chunk's unresolved nodes (kind 0) and the nodes that it asks for (kind 1)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grp, no, start, n, total, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = level_sizes(total)
                levels = chunk_forest(_hex(blob), start, sizes)
                for level, row in enumerate(levels):
                    above = levels[level + 1] if level + 1 < len(levels) else {}
                    rows += [(0, grp, no, level, i, h) for i, h in row.items() if i // 2 not in above]
                rows += [(1, grp, no, level, i, None) for level, i in outside(levels, start, n, sizes)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "grp", "no", "level", "idx", "hash"])

    return chunks.select("grp", "no", "start", "n", "total", "leaves").mapInArrow(grow, f"kind int, {_NODES}")


def reduce_forests(forests: DataFrame, totals: DataFrame, chunks: int, space: Workspace, name: str, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(roots (grp, root), all nodes that left a chunk): `fan` neighbouring forests become one, until each
    group of `totals` (grp, total) has a single one.  `chunks` is the largest number of a group's."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        r = rows.to_pydict()
        nodes = {(a, b): h for a, b, h in zip(r["level"], r["idx"], r["hash"], strict=True)}
        made, left = combine(nodes, level_sizes(r["total"][0]))
        out = [(key[0].as_py(), key[1].as_py(), *k, h, k in made, k in left) for k, h in (nodes | made).items() if k in made or k in left]
        cols = list(zip(*out, strict=True))
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["grp", "no", "level", "idx", "hash", "made", "open"])

    columns = ["grp", "no", "level", "idx", "hash"]
    nodes = now = forests.select(*columns)
    step = 0
    while True:
        keyed = now.join(totals, "grp").withColumn("no", F.floor(F.col("no") / fan))
        now = space.save(keyed.groupBy("grp", "no").applyInArrow(merge, f"{_NODES}, made boolean, open boolean"), f"{name}{step}")
        nodes = nodes.unionByName(now.where("made").select(*columns))
        now, chunks, step = now.where("open").select(*columns), -(-chunks // fan), step + 1
        if chunks <= 1:
            return now.select("grp", F.col("hash").alias("root")), nodes


class Tree:
    """Groups' trees over leaves (grp, id, leaf, other): chunks with the nodes they need, and roots."""

    def __init__(self, leaves: DataFrame, space: Workspace, name: str, chunk: int = CHUNK, fan: int = FAN):
        packed = space.save(_chunks(leaves, chunk), f"{name}_chunks")
        numbers = space.save(_numbered(packed), f"{name}_numbers")
        chunks = packed.drop("n").join(numbers, ["part", "seq", "grp"])
        found = space.save(_forests(chunks), f"{name}_forests")
        totals = numbers.groupBy("grp").agg(F.max("total").alias("total"))
        most = (numbers.agg(F.max("no")).first()[0] or 0) + 1
        roots, nodes = reduce_forests(found.where("kind = 0"), totals, most, space, f"{name}_round", fan)
        self.roots = space.save(roots, f"{name}_roots")
        asked = found.where("kind = 1").select("grp", "no", "level", "idx")
        answers = asked.join(nodes.select("grp", "level", "idx", "hash"), ["grp", "level", "idx"])
        answers = answers.groupBy("grp", "no").agg(F.collect_list(F.struct("level", "idx", "hash")).alias("near"))
        # At most four answers a level for each chunk.
        self.chunks = chunks.join(answers, ["grp", "no"], "left").join(self.roots, "grp")


def siblings(pos: int, sizes: list[int], nodes: list[dict[int, str]]) -> list[tuple[bool, str] | None]:
    """For each level below the root: whether the sibling stands left, and its hash; None for a run of one."""
    out = []
    for level, size in enumerate(sizes[:-1]):
        s = (pos >> level) ^ 1
        out.append((s < pos >> level, nodes[level][s]) if s < size else None)
    return out


def fold(leaf: str, path: list[tuple[bool, str] | None]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        leaf = digest(leaf) if step is None else digest(step[1], leaf) if step[0] else digest(leaf, step[1])
    return leaf


def _paths(row: dict) -> Iterator[tuple[str | None, str, str, list]]:
    """(id, leaf, other, path) of a chunk's leaves."""
    sizes, leaves, start = level_sizes(row["total"]), _hex(row["leaves"]), row["start"]
    nodes = chunk_forest(leaves, start, sizes)
    nodes += [{} for _ in range(len(sizes) - len(nodes))]
    for x in row["near"] or ():
        nodes[x["level"]][x["idx"]] = x["hash"]
    for i, (name, leaf, other) in enumerate(zip(row["names"], leaves, _hex(row["others"]), strict=True)):
        yield name, leaf, other, siblings(start + i, sizes, nodes)


_STEP = "array<struct<left: boolean, hash: string>>"
_STEP_TYPE = pa.list_(pa.struct([("left", pa.bool_()), ("hash", pa.string())]))


def merkle_manifest(df: DataFrame, *, group: str = "lang", fields: tuple[str, ...] = FIELDS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, grp).

    The first of `fields` is the id, the fourth the number that tampering raises.
    """
    space = Workspace(df.sparkSession)
    cols = [F.col(f) for f in fields]
    # The id's decimal digits decide which rows are tampered with.
    chosen = F.crc32(cols[0].cast("string").cast("binary")) % 7 == 0
    raised = [*cols[:3], cols[3] + 1, *cols[4:]]
    leaf = leaf_hash(cols)
    leaves = df.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n")).alias("grp"), cols[0].cast("long").alias("id"), leaf.alias("leaf"),
        F.when(chosen & cols[3].isNotNull(), leaf_hash(raised)).otherwise(leaf).alias("other"))
    tree = Tree(leaves, space, "tree", chunk, fan)
    # Groups are the leaves of the top tree; 'n' sorts before 's...', so null comes first.
    tops = Tree(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf"), F.col("root").alias("other")), space, "top", chunk, fan)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, row["root"], [s and {"left": s[0], "hash": s[1]} for s in path]) for row in batch.to_pylist() for name, _, _, path in _paths(row)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), _STEP_TYPE), strict=True)], names=["grp", "top", "above"])

    above = tops.chunks.select("names", "leaves", "others", "start", "total", "near", "root").mapInArrow(climb, f"grp string, top string, above {_STEP}")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rest = [s and (s["left"], s["hash"]) for s in row["above"]]
                rows = []
                for name, leaf, other, path in _paths(row):
                    path += rest
                    got = fold(other, path)
                    proof = digest(*(s[1] for s in path if s))
                    rows.append((name and int(name), leaf, row["root"], row["top"], proof, got, got == row["top"], None if row["grp"] == "n" else row["grp"][1:]))
                types = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "grp"])

    chunks = tree.chunks.join(above, "grp").select("names", "leaves", "others", "start", "total", "near", "root", "top", "above", "grp")
    return chunks.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, grp string")
