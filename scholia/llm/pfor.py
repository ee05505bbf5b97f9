"""Patched frame-of-reference files of token ids.

A file holds documents in order.  Layout, little-endian:

    magic "PFR1", u32 documents, u32 ids, u32 blocks
    i64 document ids, u8 null flags, u32 end of each document (in ids)
    u32 start of each block (in bytes from the first block), one more for the end
    blocks: u32 minimum, u8 width, u16 exceptions, packed u64 words,
            u16 exception places, u32 exception values

A block has 512 ids (the last is padded with its minimum).  Its width is the least that
holds the offsets from the minimum up to a percentile; offsets above it are exceptions,
stored whole.  Block starts let a reader fetch any id range without decoding the rest.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
PERCENTILE = 90
_MAGIC = b"PFR1"
_LANES = 64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 512 offsets to rows of 8 * width words: 64 values fill `width` words."""
    lanes = np.ascontiguousarray(values.reshape(-1, _LANES).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for j in range(_LANES):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((_LANES, lanes.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(_LANES):
        word, shift = divmod(j * width, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return np.ascontiguousarray(out.T).reshape(len(words), -1).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Block bytes and block starts of an array of ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(1, dtype="<u4")
    padded = np.full(n * BLOCK, ids[(n - 1) * BLOCK :].min(), dtype=np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n, BLOCK)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    k = min(BLOCK - 1, BLOCK * percentile // 100)
    top = np.partition(rows, k, axis=1)[:, k]
    widths = np.frexp(top.astype(np.float64))[1].astype(np.int64)
    limits = np.left_shift(np.ones(n, dtype=np.uint64), widths.astype(np.uint64))
    outlier = rows >= limits[:, None]
    parts: list[bytes] = [b""] * n
    where_row, where_col = np.nonzero(outlier)
    values = rows[where_row, where_col].astype("<u4")
    rows = np.where(outlier, 0, rows)
    bounds = np.searchsorted(where_row, np.arange(n + 1))
    where_col = where_col.astype("<u2")
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        words = _pack(rows[at], width) if width else None
        for j, i in enumerate(at.tolist()):
            a, b = bounds[i], bounds[i + 1]
            parts[i] = b"".join((
                struct.pack("<IBH", low[i], width, b - a), words[j].tobytes() if width else b"",
                where_col[a:b].tobytes(), values[a:b].tobytes(),
            ))
    starts = np.zeros(n + 1, dtype="<u4")
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return b"".join(parts), starts


def decode_blocks(blob: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    n = len(starts) - 1
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    heads = [struct.unpack_from("<IBH", blob, s) for s in starts[:-1].tolist()]
    by_width: dict[int, list[int]] = {}
    for i, (_, width, _n) in enumerate(heads):
        by_width.setdefault(width, []).append(i)
    for width, at in by_width.items():
        if width:
            words = np.frombuffer(b"".join([blob[starts[i] + 7 : starts[i] + 7 + width * BLOCK // 8] for i in at]), dtype="<u8")
            out[at] = _unpack(words.reshape(len(at), -1), width)
    for i, (_, width, m) in enumerate(heads):
        if m:
            at = int(starts[i]) + 7 + width * BLOCK // 8
            places = np.frombuffer(blob, dtype="<u2", count=m, offset=at)
            out[i, places] = np.frombuffer(blob, dtype="<u4", count=m, offset=at + 2 * m)
    out += np.array([h[0] for h in heads], dtype=np.uint32)[:, None] if n else 0
    return out.reshape(-1)[:n_ids]


def write_file(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    blob, starts = encode_blocks(ids)
    ends = np.cumsum([len(d) for d in docs]).astype("<u4")
    return b"".join((
        _MAGIC, struct.pack("<III", len(docs), len(ids), len(starts) - 1),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        ends.tobytes(), starts.tobytes(), blob,
    ))


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, end of each document and all ids of a file."""
    if data[:4] != _MAGIC:
        raise ValueError("not a patched frame-of-reference file")
    n_docs, n_ids, n_blocks = struct.unpack_from("<III", data, 4)
    at = 16
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    null = np.frombuffer(data, "u1", n_docs, at)
    at += n_docs
    ends = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    starts = np.frombuffer(data, "<u4", n_blocks + 1, at).astype(np.int64)
    ids = decode_blocks(data[at + 4 * (n_blocks + 1) :], starts, n_ids)
    return [None if z else d for d, z in zip(doc_ids, null, strict=True)], ends, ids
