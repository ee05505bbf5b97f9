"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A text is the multiset of its paragraphs (its lines).  A paragraph's vector has `LANES`
64-bit numbers from a BLAKE2b digest of its bytes, and `WIDTH` numbers that count its five-word
shingles, each with a hashed sign in a hashed place.  A fingerprint is the sum of the
paragraphs' vectors, the first part modulo 2 ** 64, the second modulo 2 ** 16, so

* texts with the same paragraphs in any order have equal fingerprints;
* inserting or deleting a paragraph adds or subtracts its vector, without the rest of the text;
* the difference of the second parts estimates how many shingles two texts do not share.

`edited_neighbours` edits every document with a piece of the next one and gets the edited
fingerprint by deletion and insertion: the cut paragraphs are taken off, the piece's whole
paragraphs are added, and only the two paragraphs at the seam and at the piece's end are new.

Distribution: buckets are ranges of the id (quantiles of all ids), so documents move once,
sorted by id; the first document of each bucket also goes to the bucket before it, where it
is the next of the last one.  Rows without an id are split by ranges of their text's hash.

Defined results: null texts are empty; an empty text is one empty paragraph; a paragraph of
fewer than five words is one shingle, one without words has none; two texts without shingles
are alike (1.0) if their fingerprints agree, else not (0.0); rows of one id follow each other
by the hash of their text; null ids come last; one row alone is its own next; an empty
table gives an empty result; other columns, whatever their names, are not read.  A very
long text is hashed in blocks of paragraphs.  Rows of one id stay in one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Prefix, mix
from .common import bound_batches, text_hash

#: 64-bit sums of digests, 16-bit counts of shingles, words of a shingle.
LANES, WIDTH, SHINGLE = 8, 256, 5
#: Buckets for each shuffle partition, which even out what a task gets.
SPREAD = 8
#: Bytes and rows that a task hashes at once.
_BYTES, _ROWS = 2 << 20, 1000

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TURN = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the paragraph, hash) of every shingle of `SHINGLE` words."""
    data = np.frombuffer(b"\n".join(paragraphs) + b"\n", dtype=np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return none, none.astype(np.uint64)
    words = mix(Prefix(data).span(starts, ends) + (ends - starts).astype(np.uint64))
    of = np.searchsorted(np.cumsum([len(p) + 1 for p in paragraphs]), starts, side="right")
    # Shingles begin at each word with enough words behind it, and at the first of a short paragraph.
    first = np.concatenate(([True], of[1:] != of[:-1]))
    last = np.repeat(np.append(np.flatnonzero(first)[1:], len(of)), np.diff(np.append(np.flatnonzero(first), len(of))))
    at = np.flatnonzero(first | (np.arange(len(of)) + SHINGLE <= last))
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = at + k < last[at]
        total = total * _TURN + np.where(inside, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))
    return of[at], mix(total)


def digests(paragraphs: list[bytes]) -> np.ndarray:
    """A row of `LANES` numbers for each paragraph."""
    raw = b"".join([hashlib.blake2b(p, digest_size=8 * LANES).digest() for p in paragraphs])
    return np.frombuffer(raw, dtype="<u8").reshape(-1, LANES)


class Sums:
    """Vectors of several multisets of paragraphs, grown by blocks of paragraphs."""

    def __init__(self, n: int):
        self.lanes = np.zeros((n, LANES), dtype=np.uint64)
        self.counts = np.zeros((n, WIDTH), dtype=np.int64)

    def add(self, owner: np.ndarray, lanes: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> None:
        """Adds paragraphs to their owners; -1 owns nothing.  `of` and `hashes` are the paragraphs' shingles."""
        own = owner >= 0
        np.add.at(self.lanes, owner[own], lanes[own])
        mine = own[of]
        place = owner[of[mine]] * WIDTH + (hashes[mine] % np.uint64(WIDTH)).astype(np.int64)
        sign = ((hashes[mine] >> np.uint64(32)) & np.uint64(1)).astype(np.float64) * 2 - 1
        self.counts += np.bincount(place, sign, self.counts.size).astype(np.int64).reshape(self.counts.shape)


def blocks(paragraphs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of paragraphs of about `_BYTES` bytes."""
    start = size = 0
    for i, p in enumerate(paragraphs):
        size += len(p) + 64
        if size >= _BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(paragraphs):
        yield start, len(paragraphs)


def add_all(paragraphs: list[bytes], *owners: tuple[Sums, np.ndarray]) -> None:
    for a, b in blocks(paragraphs):
        part = paragraphs[a:b]
        lanes, (of, hashes) = digests(part), shingle_hashes(part)
        for sums, owner in owners:
            sums.add(owner[a:b], lanes, of, hashes)


def as_text(lanes: np.ndarray, counts: np.ndarray) -> str:
    return lanes.astype("<u8").tobytes().hex() + (counts & 0xFFFF).astype("<u2").tobytes().hex()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * LANES], dtype="<u8"), np.frombuffer(raw[8 * LANES :], dtype="<i2").astype(np.int64)


def combined(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint with the paragraphs of another inserted (1) or deleted (-1)."""
    (x, p), (y, q) = from_text(a), from_text(b)
    return as_text(x + y if sign > 0 else x - y, p + sign * q)


def fingerprints(texts: list[str | None]) -> list[str]:
    """The fingerprints of whole texts."""
    split = [(t or "").encode().split(b"\n") for t in texts]
    sums = Sums(len(split))
    add_all([p for ps in split for p in ps], (sums, np.repeat(np.arange(len(split)), [len(p) for p in split])))
    return [as_text(a, b) for a, b in zip(sums.lanes, sums.counts, strict=True)]


def likenesses(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shared share of the shingles of two texts, estimated from rows of (lanes, counts)."""
    a, b = (x[1].astype(np.int16).astype(np.float64) for x in (left, right))
    gap = (left[1] - right[1]).astype(np.int16).astype(np.float64)
    size = (a * a).sum(axis=1) + (b * b).sum(axis=1)
    alike = np.clip(1 - (gap * gap).sum(axis=1) / np.maximum(size, 1), 0, 1)
    same = (left[0] == right[0]).all(axis=1)
    return np.where(same & (gap == 0).all(axis=1), 1.0, np.where(size > 0, alike, 0.0))


def likeness(a: str, b: str) -> float:
    (x, p), (y, q) = from_text(a), from_text(b)
    return float(likenesses((x[None], p[None]), (y[None], q[None]))[0])


def _edited(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """Result rows of all but the last of consecutive documents."""
    n = len(rows) - 1
    texts = [t or "" for _, t in rows]
    split = [t.encode().split(b"\n") for t in texts]
    every = [p for ps in split for p in ps]
    sizes = np.array([len(p) for p in split])
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(n + 1), sizes)
    cut_of, inserted_of = np.full(len(every), -1), np.full(len(every), -1)
    seams, seam_of, hashes = [], [], []
    for i in range(n):
        text, after = texts[i], texts[i + 1]
        half = len(text) // 2
        kept, piece = text[: len(text) - half], after[:half]
        hashes.append(hashlib.sha256((kept + piece).encode()).hexdigest())
        # Paragraphs from the cut on are deleted; the piece's whole ones are inserted.
        cut_of[first[i] + kept.count("\n") : first[i] + sizes[i]] = i
        lines = piece.split("\n")
        inserted_of[first[i + 1] + 1 : first[i + 1] + max(1, len(lines) - 1)] = i
        seams.append((kept[kept.rfind("\n") + 1 :] + lines[0]).encode())
        seam_of.append(i)
        if len(lines) > 1:
            seams.append(lines[-1].encode())
            seam_of.append(i)
    whole, cut, new = Sums(n + 1), Sums(n), Sums(n)
    add_all(every, (whole, of), (cut, cut_of), (new, inserted_of))
    add_all(seams, (new, np.array(seam_of, dtype=np.int64)))
    lanes, counts = whole.lanes[:n] - cut.lanes + new.lanes, whole.counts[:n] - cut.counts + new.counts
    own = (whole.lanes[:n], whole.counts[:n])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([r[0] for r in rows[:n]], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": hashes, "fingerprint": [as_text(a, b) for a, b in zip(*own, strict=True)],
        "edited_fingerprint": [as_text(a, b) for a, b in zip(lanes, counts, strict=True)],
        "near_edited": likenesses(own, (lanes, counts)), "near_next": likenesses(own, (whole.lanes[1:], whole.counts[1:]))})


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a bucket in order, the copied first one of the next bucket behind them."""
    bucket, held, size, over = None, [], 0, False
    for batch in batches:
        for b, borrowed, name, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "borrowed", "id", "text")), strict=True):
            if b != bucket:
                bucket, held, size, over = b, [], 0, False
            if over:
                continue
            held.append((name, text))
            size += len(text or "")
            over = borrowed
            if over or len(held) > _ROWS or size >= _BYTES and len(held) > 1:
                yield _edited(held)
                held, size = held[-1:], len(text or "")


def edited_neighbours(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next one by descending id."""
    spark = df.sparkSession
    bound_batches(spark)
    ids = df.select(F.col(doc_id).cast("long").alias("id"))
    wanted = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / wanted for i in range(1, wanted)]
    seen = ids.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"), F.percentile_approx("id", shares, 10 * wanted).alias("cuts")).first()
    cuts = sorted({0.0, *map(float, seen["cuts"] or ())})
    # Buckets descend: 0 holds the largest ids, rows without one come behind all others.
    dealer = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="range")
    n_ranges, n_hashes = len(cuts) + 1, max(1, -(-seen["nulls"] * wanted // max(1, seen["n"])))
    big = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    step = -(-(1 << 64) // n_hashes)

    def dealt(rows: DataFrame, th) -> DataFrame:  # noqa: ANN001
        placed = dealer.transform(rows.withColumn("place", F.coalesce(F.col("id").cast("double"), F.lit(0.0))))
        nameless = n_ranges + F.floor((th.cast("decimal(20,0)") + big(1 << 63)) / big(step))
        bucket = F.when(F.col("id").isNull(), nameless).otherwise(n_ranges - 1 - F.col("range"))
        return placed.withColumn("bucket", bucket.cast("int")).drop("place", "range")

    # The first document of each bucket, by id or, without ids, by its text's hash: at most `wanted` rows of each kind.
    firsts = [(r["bucket"], r["first"], False) for r in dealt(ids.where("id IS NOT NULL"), F.lit(0)).groupBy("bucket").agg(F.max("id").alias("first")).collect()]
    if seen["nulls"]:
        none = df.where(F.col(doc_id).isNull()).select(F.lit(None).cast("long").alias("id"), text_hash(F.col(text)).alias("th"))
        firsts += [(r["bucket"], r["first"], True) for r in dealt(none, F.col("th")).groupBy("bucket").agg(F.min("th").alias("first")).collect()]
    firsts.sort()
    loans = [(first, nameless, firsts[i - 1][0]) for i, (_, first, nameless) in enumerate(firsts)]
    lent = F.broadcast(spark.createDataFrame(loans, "first long, nameless boolean, lender_bucket int"))
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), text_hash(F.col(text)).alias("th"))
    rows = dealt(rows, F.col("th"))
    first = F.coalesce("id", "th")
    rows = rows.join(lent, (first == F.col("first")) & (F.col("id").isNull() == F.col("nameless")), "left")
    place = lambda bucket, borrowed: F.struct(bucket.alias("bucket"), F.lit(borrowed).alias("borrowed"))
    places = F.array_compact(F.array(place(F.col("bucket"), False), F.when(F.col("lender_bucket").isNotNull(), place(F.col("lender_bucket"), True))))
    placed = rows.select("id", "text", "th", F.explode(places).alias("p")).select("p.bucket", "p.borrowed", "id", "text", "th")
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "borrowed", F.col("id").desc_nulls_last(), "th")
    return ordered.select("bucket", "borrowed", "id", "text").mapInArrow(_walk, _RESULT)
