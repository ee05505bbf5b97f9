"""Token-id output: whole documents, in ascending id order, in patched frame-of-reference files.

Documents are range-partitioned and sorted by id; every partition encodes its texts and
writes files of about a million ids.  A file is one binary value of a Parquet table in the
shared folder, so Spark's committer makes the output whole when executors are lost, and
any file can be read alone.  Reading decodes the files again and adds each document's
place among all ids from prefix sums over files and partitions.

Defined results: null and empty texts have the end id only; null ids come first; repeated
rows and equal ids stay separate rows in the order of the text's hash; an empty table
gives no files and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import pfor
from .common import Workspace
from .tokens import encoder, vocabulary_path

#: Ids after which a file is closed; a longer document makes a longer file.
FILE_IDS = 1 << 20
#: Texts that go to the encoder at once.
_TEXTS = 500

_FILES = "part int, seg int, n_docs long, n_ids long, payload binary"
_DOCS = "doc_id long, part int, seg int, row int, seg_start long, n_tokens long, ids_crc32 long"


def write_token_files(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, workspace: Workspace | None = None
) -> DataFrame:
    """The table of files (part, seg, n_docs, n_ids, payload), written to the shared folder."""
    path = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "n_docs": [len(docs)],
                "n_ids": [held], "payload": pa.array([pfor.write_file(names, docs)], pa.binary()),
            })

        for batch in batches:
            for i in range(0, batch.num_rows, _TEXTS):
                rows = batch.slice(i, _TEXTS)
                texts = encoder(path).encode(rows.column(1).to_pylist())
                for name, ids in zip(rows.column(0).to_pylist(), texts, strict=True):
                    names.append(name)
                    docs.append(ids)
                    held += len(ids)
                    if held >= FILE_IDS:
                        yield file()
                        seg, held, names, docs = seg + 1, 0, [], []
        if docs:
            yield file()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return (workspace or Workspace(df.sparkSession)).save(ordered.mapInArrow(write, _FILES), "token_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) decoded from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seg", "payload")), strict=True):
                names, ends, ids = pfor.read_file(payload)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(names, pa.int64()), "part": pa.array([part] * n, pa.int32()), "seg": pa.array([seg] * n, pa.int32()),
                    "row": pa.array(range(n), pa.int32()), "seg_start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    sizes = files.select("part", "seg", "n_ids")
    zero = F.lit(0).cast("long")
    # One row for each partition of the write: a few thousand at most, whatever the corpus.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), zero).alias("part_start"))
    within = W.partitionBy("part").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    places = sizes.select("part", "seg", F.coalesce(F.sum("n_ids").over(within), zero).alias("file_start")).join(parts, "part")
    docs = files.select("part", "seg", "payload").mapInArrow(read, _DOCS)
    return docs.join(places, ["part", "seg"]).select(
        "doc_id", (F.col("part_start") + F.col("file_start") + F.col("seg_start")).alias("start"), "n_tokens", "ids_crc32"
    )
