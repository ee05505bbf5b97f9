"""Media columns: texts stored as baseline JPEG, read back, with dimensions and thumbnail hashes.

`media_column` stores each text's bytes, padded with zeros to a positive multiple of 64, as
the DC samples of JPEG images (`jpeg`); `media_features` reads any column of baseline JPEG
bytes.  Both are narrow: a scan and two Arrow stages, no exchange.  The stored form is a
binary column, so a plan may write it or hand it on.

Defined results: a null or empty text is one row of 64 zero samples; a text of any length is
a run of images of bounded height; null ids and repeated rows are kept row by row; a null
media value has null features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg

#: Bytes of text or media that an output batch gathers.
_BATCH_BYTES = 4 << 20


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with a few megabytes in one column."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= _BATCH_BYTES:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def media_column(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            texts = part.column(1).to_pylist()
            media = jpeg.encode_all([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Rows of `media_column` with what reading the stored bytes back gives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 2):
            stored = part.column(2).to_pylist()
            out: list[tuple] = []
            for data, thumbs in zip(stored, jpeg.thumbnails([s or b"" for s in stored]), strict=True):
                if data is None:
                    out.append((None,) * 6)
                    continue
                payload = b"".join([t.tobytes() for t in thumbs])
                shape = "+".join(f"{t.shape[1] * 8}x{t.shape[0] * 8}" for t in thumbs)
                feature = f"{shape};{'+'.join(jpeg.average_hash(t) for t in thumbs)}"
                out.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(data), hashlib.sha256(data).hexdigest(), feature,
                ))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *cols],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )
