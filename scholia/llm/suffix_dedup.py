"""Exact removal of repeated 100-byte strings by hash-compared suffix sorting.

A byte goes if a 100-byte string over it also starts earlier (smaller id, or same document
and earlier start).  It is found in three steps, none of which pairs documents:

1. Texts are cut into content-defined segments (`anchors`), about one for 35 bytes.  Rows of
   four numbers are dealt by anchor value and sorted.  Segments with equal content (by two
   independent 64-bit hashes, of the anchor's bytes and of all, and the length) are copies:
   all but the earliest go whole.  They rest on the hashes, their bytes are not moved.
2. What is left to compare are first segments that share an anchor value with others, or
   in which the anchor repeats.
   Their bytes (169 at most) are fetched once and dealt by anchor value.  The suffixes that
   start their windows are merge-sorted: prefix polynomial hashes and binary search give two
   suffixes' common extension in log2(100) steps, and neighbours that extend over 100 bytes
   are equal windows; each such hit is verified on the bytes.
3. The removed runs of each document are joined with its text.

Hot anchor values (a line that a third of all documents hold) are dealt out in chunks of
`CHUNK` segments; windows that stay first in their chunk then meet by two independent 64-bit
hashes, again without their bytes, with the earliest place aggregated before the shuffle.

Defined results: null is an empty text; a null id comes before all others; rows that share
an id count as one document, in which an equal place is not an earlier one (so repeated rows
get equal results); an empty table gives an empty result.  Bytes that are left over from a
cut multi-byte character are dropped from the text by `deduplicated`, not from the digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import WINDOW
from .common import Columns, Workspace, text_hash

#: Segments of one anchor value that one task compares, and bytes sorted at a time.
CHUNK = 4096
SORT_BYTES = 1 << 20
#: Stands for a null id; places are start * 256 + 128 if windows may repeat + number of windows.
NULL_ID = -(1 << 63)
_STEP, _REPEATS, _COUNT = 256, 128, 127

_SEGMENT = "m long, seg long, doc long, th long, pos long"


def _split(text_rows: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for i, n in enumerate(pc.binary_length(text_rows.column("text")).to_pylist()):
        held += n
        if held >= size:
            yield text_rows.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < text_rows.num_rows:
        yield text_rows.slice(start)


def _documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc"), text_hash(F.col(text)).alias("th"), body.alias("text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _split(batch):
            texts = [t.encode() for t in part.column("text").to_pylist()]
            at, start, count, repeats, least, content = anchors.segments(texts)
            docs = part.column("doc").to_numpy(zero_copy_only=False)
            ths = part.column("th").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), pa.array(docs[at]), pa.array(ths[at]), pa.array(start * _STEP + repeats * _REPEATS + count)],
                names=["m", "seg", "doc", "th", "pos"],
            )


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (m, seg, doc, pos): copies (chunk -1) and firsts to compare (chunk >= 0)."""
    prev = None  # last row's (m, seg, doc, start)
    head = None  # earliest place of the running (m, seg)
    waiting = None  # the first segment of the running m, until a second one shows
    n_firsts = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        m, seg, doc, pos = (batch.column(c).to_numpy() for c in ("m", "seg", "doc", "pos"))
        th = batch.column("th").to_numpy()
        n = len(m)
        new_m = np.ones(n, dtype=bool)
        new_m[1:] = m[1:] != m[:-1]
        new_seg = new_m.copy()
        new_seg[1:] |= seg[1:] != seg[:-1]
        if prev is not None:
            new_m[0] = m[0] != prev[0]
            new_seg[0] = new_m[0] or seg[0] != prev[1]
        # The earliest place of each row's class: its first row in the sort.
        first = np.maximum.accumulate(np.where(new_seg, np.arange(n), -1))
        head_doc, head_pos = doc[np.maximum(first, 0)], pos[np.maximum(first, 0)]
        if head is not None and not new_seg[0]:
            carried = first < 0
            head_doc[carried], head_pos[carried] = head
        copy = (doc != head_doc) | (pos != head_pos)
        # Number of each first segment within its m.
        firsts = np.flatnonzero(new_seg)
        out_at = [np.flatnonzero(copy)]
        out_chunk = [np.full(len(out_at[0]), -1, dtype=np.int64)]
        extra: list[tuple] = []
        if len(firsts):
            starts_m = np.flatnonzero(new_m)
            group = np.searchsorted(starts_m, firsts, side="right")  # 0: the m carried over
            base = np.searchsorted(firsts, starts_m)
            offset = np.where(group > 0, base[np.maximum(group - 1, 0)] if len(starts_m) else 0, -n_firsts)
            number = np.arange(len(firsts)) - offset
            sizes = np.bincount(group, minlength=len(starts_m) + 1)
            company = (sizes[group] > 1) | (pos[firsts] & _REPEATS > 0)
            if sizes[0]:
                company[group == 0] = True
                if waiting is not None and n_firsts == 1:
                    extra.append(waiting)
            last = len(starts_m)
            # The last m may go on in the next batch: hold its only segment back.
            out_first = firsts[company]
            out_at.append(out_first)
            out_chunk.append(number[company] // CHUNK)
            if last:
                n_firsts = int(sizes[last])
                k = firsts[-1]
                waiting = None if pos[k] & _REPEATS else (m[k], doc[k], th[k], pos[k])
            else:
                n_firsts += int(sizes[0])
        at, chunk = np.concatenate(out_at), np.concatenate(out_chunk)
        cols = [np.concatenate((c[at], np.array([e[i] for e in extra], dtype=c.dtype))) for i, c in enumerate((m, doc, th, pos))]
        chunk = np.concatenate((chunk, np.zeros(len(extra), dtype=np.int64)))
        prev = (m[-1], seg[-1])
        head = (head_doc[-1], head_pos[-1])
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(chunk)], names=["m", "doc", "th", "pos", "chunk"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments listed with each text."""
    for batch in batches:
        for part in _split(batch):
            rows: list[tuple] = []
            for doc, th, text, segs in zip(*(part.column(c).to_pylist() for c in ("doc", "th", "text", "segs")), strict=True):
                data = text.encode()
                for s in segs:
                    start, n = s["pos"] // _STEP, s["pos"] & _COUNT
                    rows.append((s["m"], s["chunk"], doc, th, s["pos"], data[start : start + n + WINDOW - 1]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["m", "chunk", "doc", "th", "pos", "data"],
                )


class SuffixSorter:
    """Sorts suffixes of a byte array by their first `WINDOW` bytes, within groups."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        self.prefix = anchors.Prefix(data)

    def words(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, as numbers that compare like the bytes."""
        out = np.zeros(len(at), dtype=np.uint64)
        for i in range(8):
            out = (out << np.uint64(8)) | self.data[at + i]
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of suffix pairs, up to `WINDOW`, by binary search on prefix hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), WINDOW, dtype=np.int64)
        for _ in range(WINDOW.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.prefix.span(a, a + mid) == self.prefix.span(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray, order: np.ndarray, ia: np.ndarray, ib: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts after suffix b; equal windows by their order."""
        out = order[ia] > order[ib]
        differ = np.flatnonzero(whole[ia] != whole[ib])
        if len(differ):
            x, y = a[differ], b[differ]
            e = self.extension(x, y)
            out[differ] = np.where(e >= WINDOW, out[differ], self.data[x + np.minimum(e, WINDOW - 1)] > self.data[y + np.minimum(e, WINDOW - 1)])
        return out

    def sort(self, at: np.ndarray, group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of `at` sorted by (group, window, order), and whether each equals the one before.

        Runs of equal (group, first eight bytes) come from a radix sort; each run is then
        merge-sorted bottom-up, all runs of a level at once: an element's new place is its
        place in its half plus its rank in the other half, found by binary search.
        """
        n = len(at)
        first = self.words(at)
        index = np.lexsort((first, group))
        new = np.ones(n, dtype=bool)
        new[1:] = (group[index][1:] != group[index][:-1]) | (first[index][1:] != first[index][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        whole = self.prefix.span(at, at + WINDOW)
        width, longest = 1, int(sizes.max()) if n else 0
        while width < longest:
            big = sizes > width
            s, z = starts[big], sizes[big]
            base = np.repeat(s, z)
            local = np.arange(len(base)) - np.repeat(np.cumsum(z) - z, z)
            size = np.repeat(z, z)
            run = local // width
            other = run ^ 1
            low, high = np.minimum(other * width, size), np.minimum((other + 1) * width, size)
            me = index[base + local]
            rank_from = low.copy()
            open_ = low < high
            while open_.any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) >> 1
                it = index[base[k] + mid]
                mine = me[k]
                up = self.after(at[mine], at[it], order, mine, it, whole)
                low[k] = np.where(up, mid + 1, low[k])
                high[k] = np.where(up, high[k], mid)
                open_[k] = low[k] < high[k]
            index[base + (run & ~1) * width + (local - run * width) + (low - rank_from)] = me
            width *= 2
        equal = np.zeros(n, dtype=bool)
        if n > 1:
            a, b = index[1:], index[:-1]
            equal[1:] = (group[a] == group[b]) & (whole[a] == whole[b])
            hit = np.flatnonzero(equal)
            # Verification of what the hashes say.
            for i in (*range(0, WINDOW - 8, 8), WINDOW - 8):
                same = self.words(at[index[hit]] + i) == self.words(at[index[hit - 1]] + i)
                equal[hit[~same]] = False
                hit = hit[same]
        return index, equal


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that start earlier in another segment of the group (hash -1), and from
    full chunks the windows that are first there (by hash, to meet those of other chunks)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("data").nbytes
        if size >= SORT_BYTES:
            rows = pa.Table.from_batches(held).combine_chunks()
            m, chunk = rows.column("m").to_numpy(), rows.column("chunk").to_numpy()
            # Rows are sorted by (m, chunk): what the last group still awaits is carried over.
            cut = int(np.flatnonzero((m != m[-1]) | (chunk != chunk[-1]))[-1]) + 1 if ((m != m[-1]) | (chunk != chunk[-1])).any() else 0
            if cut:
                yield from _compare_rows(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(b.column("data").nbytes for b in held)
    if held:
        yield from _compare_rows(pa.Table.from_batches(held))


def _compare_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    m, chunk, doc, th, pos = (rows.column(c).to_numpy() for c in ("m", "chunk", "doc", "th", "pos"))
    data = np.frombuffer(b"".join(rows.column("data").to_pylist()), dtype=np.uint8)
    start, count = pos // _STEP, pos & _COUNT
    first = np.concatenate(([0], np.cumsum(count + WINDOW - 1)[:-1]))
    group = np.cumsum(np.concatenate(([0], ((m[1:] != m[:-1]) | (chunk[1:] != chunk[:-1])).astype(np.int64))))
    full = np.bincount(group)[group] >= CHUNK
    _, doc_rank = np.unique(doc, return_inverse=True)
    segment = np.repeat(np.arange(len(m)), count)
    shift = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    at = first[segment] + shift
    order = (doc_rank[segment].astype(np.int64) << 32) + start[segment] + shift
    sorter = SuffixSorter(data)
    index, equal = sorter.sort(at, group[segment], order)
    # The earliest place of each class of equal windows, and those that lie after it.
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(index))))
    removed = np.zeros(len(at), dtype=bool)
    removed[index] = order[index] > order[index[head]]
    # Removed windows in a row of one segment make a run.
    begin = removed & np.concatenate(([True], ~removed[:-1] | (segment[1:] != segment[:-1])))
    b = np.flatnonzero(begin)
    length = np.diff(np.append(np.flatnonzero(removed).searchsorted(b), removed.sum()))
    s = segment[b]
    yield _runs(doc[s], th[s], (start[s] + shift[b]) * _STEP + length, np.full(len(b), -1), np.full(len(b), -1))
    again = np.flatnonzero((full | (chunk > 0))[segment] & ~removed)
    if len(again):
        h1 = sorter.prefix.span(at[again], at[again] + WINDOW)
        h2 = anchors.Prefix(data, second=True).span(at[again], at[again] + WINDOW)
        s = segment[again]
        yield _runs(doc[s], th[s], (start[s] + shift[again]) * _STEP + 1, anchors.mix(h1).view(np.int64), anchors.mix(h2).view(np.int64))


def _runs(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(pos, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
        names=["doc", "th", "pos", "h1", "h2"],
    )


def removed_runs(df: DataFrame, space: Workspace, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, th, pos) of removed windows, pos = start * 256 + number of windows in a row."""
    docs = _documents(df, doc_id, text)
    rows = docs.mapInArrow(_cut, _SEGMENT)
    dealt = rows.repartition("m").sortWithinPartitions("m", "seg", "doc", "pos")
    found = space.save(dealt.mapInArrow(_classify, "m long, doc long, th long, pos long, chunk long"), "segments")
    listed = found.where("chunk >= 0").groupBy("doc", "th").agg(F.collect_list(F.struct("m", "chunk", "pos")).alias("segs"))
    # Repeated rows would fetch a segment twice; equal places do not remove each other.
    data = docs.join(listed, ["doc", "th"]).mapInArrow(_fetch, "m long, chunk long, doc long, th long, pos long, data binary")
    data = data.repartition("m", "chunk").sortWithinPartitions("m", "chunk", "doc", "pos")
    compared = space.save(data.mapInArrow(_compare, "doc long, th long, pos long, h1 long, h2 long"), "compared")
    copies = found.where("chunk < 0").select("doc", "th", "pos")
    runs = compared.where("h1 = -1 AND h2 = -1").select("doc", "th", "pos")
    apart = compared.where("NOT (h1 = -1 AND h2 = -1)")
    heads = apart.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("head"), F.count("*").alias("n")).where("n > 1")
    late = apart.join(heads, ["h1", "h2"]).where(F.struct("doc", "pos") > F.col("head")).select("doc", "th", "pos")
    return copies.unionByName(runs).unionByName(late)


def _kept(data: bytes, places: list[int] | None) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of removed runs."""
    keep = np.ones(len(data) + 1, dtype=bool)
    if places:
        p = np.array(places, dtype=np.int64)
        step = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(step, p // _STEP, 1)
        np.add.at(step, p // _STEP + (p & _COUNT) + WINDOW - 1, -1)
        keep[:-1] = np.cumsum(step)[:-1] == 0
    gone = ~keep
    return keep[:-1], int(np.count_nonzero(gone[1:] > gone[:-1])) + int(gone[0])


def _with_places(df: DataFrame, columns: Columns, doc_id: str, text: str) -> DataFrame:
    """The rows of `columns` with `places`, the removed runs of their text."""
    runs = removed_runs(df, Workspace(df.sparkSession), doc_id=doc_id, text=text)
    places = runs.groupBy("doc", "th").agg(F.collect_list("pos").alias("places"))
    keyed = columns.rows.withColumns({"doc": F.coalesce(columns[doc_id].cast("long"), F.lit(NULL_ID)), "th": text_hash(columns[text])})
    return keyed.join(places, ["doc", "th"], "left")


def suffix_dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, body, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                data = (body or "").encode()
                keep, spans = _kept(data, places)
                kept = np.frombuffer(data, dtype=np.uint8)[keep].tobytes() if spans else data
                out.append((name, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    columns = Columns(rows)
    found = _with_places(rows, columns, "doc_id", "text").select(columns["doc_id"].alias("doc_id"), columns["text"].alias("text"), "places")
    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(df: DataFrame) -> DataFrame:
    """The rows of `df`, whatever its columns' names, with the kept bytes as text; rows of which
    nothing but white space is left go, untouched rows stay as they are."""

    @F.pandas_udf("string")
    def kept_text(text, places):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, p in zip(text, places, strict=True):
            if p is None or t is None:
                out.append(t)
                continue
            data = t.encode()
            out.append(np.frombuffer(data, dtype=np.uint8)[_kept(data, [int(x) for x in p])[0]].tobytes().decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    # Marked as not deterministic, so that the filter does not compute it once more.
    rest = kept_text.asNondeterministic()
    columns = Columns(df)
    found = _with_places(df, columns, "doc_id", "text")
    out = found.withColumn("rest", rest(columns["text"], F.col("places")))
    out = out.where(F.col("places").isNull() | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("rest")}
    if "n_chars" in df.columns:
        n_chars = F.when(F.col("places").isNull(), columns["n_chars"]).otherwise(F.length("rest"))
        changed["n_chars"] = n_chars.cast(df.schema["n_chars"].dataType)
    return columns.back(out, **changed)
