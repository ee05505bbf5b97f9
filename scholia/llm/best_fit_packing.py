"""Best-fit packing with certified bin counts.

Documents longer than a sequence are cut into whole sequences, the remainder first.  The
pieces are dealt into partitions of bounded size by hash; each is packed best-fit
decreasing, and dual feasible functions give a lower bound on its bins.  A partition that
meets its bound is certified.  Then bins with room are released (all of them where a gap
is left, the loose ones where only rounding is left), their pieces are exchanged between
partitions and packed again, until the total meets the bound of all pieces together, one
partition held the whole pool, or a round saves nothing.

Only rows of a few numbers are shuffled, never texts or ids; the state between rounds is
written to the shared folder.

Defined results: null and empty texts are one piece with the end id; null ids and repeated
rows are packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import CACHE_PIECES, encoder, vocabulary_path

CAPACITY = 2048
#: Pieces aimed at in a partition, and the fill above which a certified partition keeps a bin.
PARTITION_PIECES = 20_000
LOOSE = 0.995

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", part long, bin int, offset long, fill int, gap int"


def cut_pieces(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
               vocabulary: str | None = None, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32); a scan, without any exchange."""
    path = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = batch.slice(i, 500)
                out: list[tuple] = []
                for name, ids in zip(rows.column(0).to_pylist(), encoder(path, cache_pieces).encode(rows.column(1).to_pylist()), strict=True):
                    raw = memoryview(ids.tobytes())
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    out += [
                        (name, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
                    ]
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, _PIECES)


def lower_bound(histogram: np.ndarray) -> int:
    """Bins that pieces need at least; histogram[x] counts the pieces of length x.

    The largest of: total volume; for each e, pieces over capacity - e as whole bins and
    pieces under e as nothing; and for each k, multiples of capacity / (k + 1) rounded up.
    """
    capacity = len(histogram) - 1
    counts = [int(c) for c in histogram]
    x = np.arange(capacity + 1, dtype=object)
    n = np.array(counts, dtype=object)
    volume = np.concatenate(([0], np.cumsum(x * n)))
    number = np.concatenate(([0], np.cumsum(n)))
    best = -(-int(volume[-1]) // capacity)
    for e in range(1, capacity // 2 + 1):
        whole = number[-1] - number[capacity - e + 1]
        middle = volume[capacity - e + 1] - volume[e]
        best = max(best, -(-(int(whole) * capacity + int(middle)) // capacity))
    for k in range(1, 25):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, given longest first, and the fill of each bin.

    Bins wait in lists by free room; a bit mask of the rooms gives the tightest one.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    bins: list[int] = []
    offsets: list[int] = []
    fill: list[int] = []
    for x in lengths:
        fitting = mask >> x
        if fitting:
            room = x + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += x
        left = room - x
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, fill


def _pack(pieces: DataFrame, n_parts: int, seed: int, capacity: int) -> DataFrame:
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)), F.lit(n_parts)))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths.tolist(), capacity)
        gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
        n = rows.num_rows
        return (
            rows.append_column("bin", pa.array(bins, pa.int32())).append_column("offset", pa.array(offsets, pa.int64()))
            .append_column("fill", pa.array(np.array(fill)[bins], pa.int32())).append_column("gap", pa.array([gap] * n, pa.int32()))
        )

    return dealt.groupBy("part").applyInArrow(pack, _PACKED)


def pack_documents(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, partition_pieces: int = PARTITION_PIECES,
    cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    space = Workspace(df.sparkSession)
    pool = space.save(cut_pieces(df, doc_id=doc_id, text=text, capacity=capacity, vocabulary=vocabulary, cache_pieces=cache_pieces), "pieces")
    names = [c.split()[0] for c in _PIECES.split(", ")]
    # At most `capacity` rows, whatever the corpus.
    by_length = pool.groupBy("length").count().collect()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_length:
        histogram[row["length"]] = row["count"]
    bound, kept_bins, done, parts_before = lower_bound(histogram), 0, [], None
    n_pool = int(histogram.sum())
    pool_bins = None
    last = None
    for r in count():  # every round but the last saves a bin, so it ends
        n_parts = max(1, -(-n_pool // partition_pieces))
        packed = space.save(_pack(pool, n_parts, r, capacity), f"round{r}").withColumn(
            "sequence_id", F.lit(r << 56) + F.col("part") * F.lit(1 << 28) + F.col("bin")
        )
        loose = (F.col("fill") < F.lit(int(capacity * LOOSE))) | ((F.col("gap") > 0) & (F.col("fill") < capacity))
        first = F.col("offset") == 0
        row = packed.agg(
            F.count_if(first).alias("bins"), F.count_if(first & loose).alias("loose"), F.count_if(loose).alias("pieces")
        ).first()
        if pool_bins is not None and row["bins"] >= pool_bins:
            done.append(last)  # this round saved nothing: the bins released before stay
            break
        stop = kept_bins + row["bins"] <= bound or (parts_before == 1 and n_parts == 1) or row["loose"] < 2
        if stop:
            done.append(packed)
            break
        done.append(packed.where(~loose))
        last = packed.where(loose)
        kept_bins += row["bins"] - row["loose"]
        pool, n_pool, pool_bins, parts_before = last.select(*names), row["pieces"], row["loose"], n_parts
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset")
