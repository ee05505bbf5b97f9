"""Token-bounded chunks with overlap: a fold over a document's segments.

The fold needs each segment in turn, so it runs as an Arrow stage over whole documents;
documents are independent, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_TOKENS = 1024, 64
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def _pack(segments: list[str], most: int, overlap: int, tokens: Callable[[str], int]) -> list[str]:
    """Greedy packing; a flushed buffer hands its longest short suffix on."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for segment in segments:
        n = tokens(segment)
        if n > most:
            if held:
                out.append("\n\n".join(s for s, _ in held))
                held, total = [], 0
            parts = [p for p in _SENTENCE.split(segment) if p.strip()]
            out += _pack(parts, most, overlap, tokens) if len(parts) > 1 else _pack_words(segment, most, overlap, tokens)
            continue
        if held and total + n > most:
            out.append("\n\n".join(s for s, _ in held))
            carried, size = [], 0
            for s, k in reversed(held):
                if size + k > overlap:
                    break
                carried.insert(0, (s, k))
                size += k
            # A buffer that fits in the overlap as a whole is not carried.
            held, total = ([], 0) if len(carried) == len(held) else (carried, size)
        held.append((segment, n))
        total += n
    if held:
        out.append("\n\n".join(s for s, _ in held))
    return out


def _pack_words(text: str, most: int, overlap: int, tokens: Callable[[str], int]) -> list[str]:
    """Words in turn; a full part hands on its last words within the overlap, unless that is all of it."""
    out, held, total = [], [], 0
    for word in text.split():
        n = tokens(word + " ")
        if held and total + n > most:
            out.append(" ".join(held))
            size, first = 0, len(held)
            while first and size + tokens(held[first - 1] + " ") <= overlap:
                first -= 1
                size += tokens(held[first] + " ")
            held = held[first:] if first and overlap > 0 else []
            total = tokens(" ".join(held) + " ") if overlap > 0 else 0
        held.append(word)
        total += n
    return [*out, " ".join(held)] if held else out


def chunk_text(text: str | None, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, tokens: Callable[[str], int] = estimate) -> list[str]:
    """The chunks of one text; blank texts have none."""
    segments = [p.strip() for p in re.split(r"\n{2,}", text or "") if p.strip()]
    return [c for c in (c.strip() for c in _pack(segments, most, overlap, tokens)) if c]


def create_chunks(
    df: DataFrame, document_id: str, content: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS
) -> DataFrame:
    """Rows (id, document_id, content, position, n_tokens)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                rows = [
                    (name, chunk, k)
                    for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for k, chunk in enumerate(chunk_text(text, max_tokens, overlap_tokens))
                ]
                names, chunks, places = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(chunks, pa.string()), pa.array(places, pa.int32())],
                    names=["document_id", "content", "position"],
                )

    rows = df.select(F.col(document_id).cast("string").alias("document_id"), F.col(content).alias("content"))
    chunks = rows.mapInArrow(cut, "document_id string, content string, position int")
    name = F.substring(F.sha2(F.concat_ws("/", "document_id", F.col("position").cast("string")), 256), 1, 12)
    return chunks.select(name.alias("id"), "document_id", "content", "position", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("long").alias("n_tokens"))
