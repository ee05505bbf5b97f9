"""Ranked lexical search: the best documents of each query item by summed term impacts.

Documents are read once for each block of items: every task counts the block's terms in
whole texts and writes them, with the text's length, to the shared folder (the matched
postings).  Sums over that table give the corpus statistics.  The postings are then
range-partitioned by document, so that all parts of a score lie in one task; a task turns
them into (item, document, impact) arrays, radix-sorts the packed item-document keys, sums
equal keys with `reduceat` and keeps the best of each item in a heap.  Tasks hand on `k`
rows for an item at most, which one window ranks.

Nothing but a block of items (`BLOCK_TERMS` item-term entries on average, whatever the number
of items) is sent to the tasks, and no table of item-document pairs exists anywhere.

Defined results: null and empty texts, and texts without terms, are not found and do not
count as documents; items without terms have no rows; items that agree in id and text are
one item, items of one id with different texts are ranked each by itself; documents are
ranked row by row, so repeated rows are found repeatedly; null ids come last among equal
scores; an empty table on either side gives an empty result; other columns, whatever their
names, are not read.  A very long text is counted a megabyte at a time.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, text_hash

#: Documents that an item keeps.
BEST = 10
#: Item-term entries that a block holds on average.
BLOCK_TERMS = 1 << 18
#: Entries of (item, document, impact) that a task sorts at once; one document may add a block's.
_ENTRIES = 1 << 21
_SLICE = 1 << 20

#: Bytes of terms: digits, letters (A-Z lower-cased) and all of other scripts; the rest are spaces.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def term_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about a megabyte of it."""
    folded = (text or b"").translate(_FOLD)
    start = 0
    while start < len(folded):
        stop = folded.find(b" ", start + _SLICE)
        stop = len(folded) if stop < 0 else stop
        yield folded[start:stop].split()
        start = stop


def _binary(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return pc.cast(batch.column(column), pa.binary()).to_pylist()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (item_id, th, terms, counts) of the distinct items that have terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, th, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _binary(batch, 2), strict=True):
                found: Counter[bytes] = Counter()
                for terms in term_lists(body):
                    found.update(terms)
                if found:
                    rows.append((name, th, list(found), list(found.values())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item_id", "th", "terms", "counts"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    rows = rows.select("item_id", text_hash(F.col("text")).alias("th"), "text")
    return rows.mapInArrow(count, "item_id long, th long, terms array<binary>, counts array<long>")


class Block:
    """Items by number, and for each term (numbered from 1) the items that hold it."""

    def __init__(self, rows: list):
        self.items = [(r["item_id"], r["th"]) for r in rows]
        self.terms: dict[bytes, int] = {}
        held: list[list[tuple[int, int]]] = []
        for i, r in enumerate(rows):
            for term, n in zip(r["terms"], r["counts"], strict=True):
                k = self.terms.setdefault(bytes(term), len(held) + 1)
                if k > len(held):
                    held.append([])
                held[k - 1].append((i, n))
        self.start = np.zeros(len(held) + 2, dtype=np.int64)
        self.start[2:] = np.cumsum([len(x) for x in held])
        flat = np.array([e for x in held for e in x], dtype=np.int64).reshape(-1, 2)
        self.item, self.repeats = flat[:, 0], flat[:, 1]


def _postings(docs: DataFrame, block) -> DataFrame:  # noqa: ANN001
    """Rows (doc_id, n, terms, tf): each document's length and the block's terms in it."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.value.terms.get
        for batch in batches:
            names, sizes, terms, counts, ends = [], [], [], [], [0]
            for name, body in zip(batch.column(0).to_pylist(), _binary(batch, 1), strict=True):
                n, found = 0, Counter()
                for part in term_lists(body):
                    n += len(part)
                    found.update(filter(None, map(number, part)))
                if n:
                    names.append(name)
                    sizes.append(n)
                    terms += found
                    counts += found.values()
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(match, "doc_id long, n long, terms array<int>, tf array<long>")


def _document_frequencies(postings: DataFrame, n_terms: int) -> DataFrame:
    """Rows (term, df); a task sums its own documents first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms + 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["term", "df"])

    return postings.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys below `most`, by counting sorts of their 16-bit digits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(1, most - 1).bit_length(), 16):
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class Best:
    """The k best documents of each item, in heaps of (score, -place, document)."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, dtype=np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, nameless: np.ndarray) -> None:
        able = score >= self.least[item]
        item, score, doc, nameless = item[able], score[able], doc[able], nameless[able]
        if not len(item):
            return
        o = np.lexsort((doc, nameless, -score, item))
        item, score, doc, nameless = item[o], score[o], doc[o], nameless[o]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        top = rank < self.k
        for i, s, d, gone in zip(item[top].tolist(), score[top].tolist(), doc[top].tolist(), nameless[top].tolist(), strict=True):
            # A null id's place is behind all others.
            entry = (s, -(1 << 63) - 1, None) if gone else (s, -d, d)
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def _scored(postings: DataFrame, block, weights: np.ndarray, k: int) -> DataFrame:  # noqa: ANN001
    """Each task's best (item_id, th, doc_id, score), from rows (doc_id, m, terms, tf)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        best = Best(len(b.items), k)
        for batch in batches:
            terms = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            m = batch.column(1).to_numpy(zero_copy_only=False)[of]
            impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            width = b.start[terms + 1] - b.start[terms]
            doc = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            nameless = pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
            # Runs of whole documents with a bounded number of entries.
            ends = np.searchsorted(of, np.arange(batch.num_rows), side="right")
            entries = np.concatenate(([0], np.cumsum(width)))
            at = 0
            while at < batch.num_rows:
                first = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(entries[ends], entries[first] + _ENTRIES, side="right")))
                rows = slice(first, ends[stop - 1])
                n = width[rows]
                place = np.repeat(b.start[terms[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if len(place):
                    keys = b.item[place] * (stop - at) + np.repeat(of[rows] - at, n)
                    values = np.repeat(impact[rows], n) * b.repeats[place]
                    order = radix_order(keys, len(b.items) * (stop - at))
                    keys = keys[order]
                    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    sums = np.add.reduceat(values[order], heads)
                    item, row = np.divmod(keys[heads], stop - at)
                    best.add(item, sums, doc[at:stop][row], nameless[at:stop][row])
                at = stop
        rows = [(*b.items[i], e[2], e[0]) for i, heap in enumerate(best.heaps) for e in heap]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "th", "doc_id", "score"])

    return postings.mapInArrow(score, "item_id long, th long, doc_id long, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = BEST,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score, item_hash): the `k` best documents of each item."""
    space, sc = Workspace(docs.sparkSession), docs.sparkSession.sparkContext
    queries = space.save(item_terms(items, item_id, item_text), "items")
    n_blocks = -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    best = None
    for i in range(n_blocks):
        # Items are dealt to blocks by hash; a block is bounded by `block_terms` on average.
        mine = queries.where(F.pmod(F.xxhash64("item_id", "th"), F.lit(n_blocks)) == i).collect()
        if not mine:
            continue
        block = sc.broadcast(Block(mine))
        n_terms = len(block.value.terms)
        postings = space.save(_postings(bodies, block), f"postings{i}")
        n_docs, length = postings.agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)"))).first()
        weights = np.zeros(n_terms + 1, dtype=np.int64)
        for r in _document_frequencies(postings, n_terms).collect():
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        if not n_docs:
            continue
        big = "decimal(38,0)"
        m = F.expr(f"CAST(25 + (CAST(75 AS {big}) * n * CAST({n_docs} AS {big})) DIV CAST({length} AS {big}) AS BIGINT)")
        found = postings.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tf")
        dealt = found.repartitionByRange(F.col("doc_id"), F.xxhash64("m", "terms"))
        rows = space.save(_scored(dealt, block, weights, k), f"best{i}")
        space.drop(f"postings{i}")
        best = rows if best is None else best.unionByName(rows)
    if best is None:
        best = queries.select("item_id", "th", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = W.partitionBy("item_id", "th").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", F.col("th").alias("item_hash"))
