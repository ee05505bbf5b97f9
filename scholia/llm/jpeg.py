"""Baseline JPEG in numpy: a DC-only writer, and a reader of DC-only luminance thumbnails.

The reader parses the markers of a baseline file, takes the entropy-coded data apart at
its restart markers and Huffman-decodes all restart intervals of all images of a batch in
step: one numpy operation reads the next symbol of every interval.  AC symbols are read
and skipped; the DC values of the first component make a thumbnail with one sample for
each 8 x 8 block.

The writer stores samples losslessly: one sample is the DC value of one 8 x 8 block, 64
blocks in a row, each row a restart interval, so a file of 512 pixels' width shows every
sample as a flat block and its thumbnail is the samples themselves.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

ROW = 64
#: Block rows in one image; longer data continues in a further image (8128 * 8 pixels < 65536).
IMAGE_ROWS = 8128
#: Samples that are coded together.
BATCH = 1 << 19

#: Lengths of the writer's DC codes by category 0 to 8: the middle categories are the common
#: ones in text.  The single AC code, of one bit, is the end of block.
_DC_BITS = {6: 2, 4: 3, 5: 3, 7: 3, 0: 4, 1: 4, 2: 4, 3: 4, 8: 4}


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of a canonical table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC_SYMBOLS = sorted(_DC_BITS, key=lambda s: (_DC_BITS[s], s))
_DC_COUNTS = [sum(b == n for b in _DC_BITS.values()) for n in range(1, 17)]


def _header(rows: int) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return b"".join((
        b"\xff\xd8",
        segment(0xDB, bytes([0, 8] + [1] * 63)),
        segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_SYMBOLS])),
        segment(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
        segment(0xDD, struct.pack(">H", ROW)),
        segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of a block (DC code, amplitude, end of block) and their number."""
    codes = _codes(_DC_COUNTS, _DC_SYMBOLS)
    bits, lengths = np.zeros(511, dtype=np.uint32), np.zeros(511, dtype=np.int32)
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        code, n = codes[category]
        amplitude = diff if diff >= 0 else diff + (1 << category) - 1
        bits[diff + 255] = ((code << category) | amplitude) << 1
        lengths[diff + 255] = n + category + 1
    return bits, lengths


_BITS, _LENGTHS = _symbols()


def _encode(images: list[np.ndarray]) -> list[bytes]:
    """Files of arrays of samples whose lengths are multiples of 64."""
    sizes = np.array([len(i) // ROW for i in images])
    rows = np.concatenate(images).reshape(-1, ROW).astype(np.int16)
    n = len(rows)
    diff = np.empty_like(rows)
    diff[:, 0] = rows[:, 0] - 128
    np.subtract(rows[:, 1:], rows[:, :-1], out=diff[:, 1:])
    diff += 255
    bits, lengths = _BITS[diff], _LENGTHS[diff]
    ends = np.cumsum(lengths, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    first = np.concatenate(([0], np.cumsum(row_bytes)))
    at = (ends - lengths + (first[:-1, None] << 3)).ravel()
    shifted = bits.ravel().astype(np.int64) << (32 - lengths.ravel() - (at & 15))
    word = at >> 4
    # The bits of a row's last byte that no code fills are ones.
    fill = (row_bytes << 3) - ends[:, -1]
    fill_at = (first[1:] << 3) - fill
    fill_bits = ((1 << fill) - 1) << (32 - fill - (fill_at & 15))
    shifted, word = np.concatenate((shifted, fill_bits)), np.concatenate((word, fill_at >> 4))
    n_words = (int(first[-1]) >> 1) + 3
    # Codes do not overlap, so sums of their shifted bits are their unions.
    words = np.bincount(word, shifted >> 16, n_words) + np.bincount(word + 1, shifted & 0xFFFF, n_words)
    stream = words.astype(">u2").view(np.uint8)[: first[-1]]
    stuffed = stream == 0xFF
    before = np.cumsum(stuffed)
    place = np.arange(len(stream)) + before - stuffed + 2 * np.repeat(np.arange(n), row_bytes)
    out = np.zeros(len(stream) + int(before[-1]) + 2 * n, dtype=np.uint8)
    out[place] = stream
    row_end = first[1:] + before[first[1:] - 1] + 2 * np.arange(n)
    image_end = np.cumsum(sizes)
    number = np.arange(n) - np.repeat(image_end - sizes, sizes)
    mark = 0xD0 + (number & 7)
    mark[image_end - 1] = 0xD9
    out[row_end], out[row_end + 1] = 0xFF, mark
    stops = (row_end[image_end - 1] + 2).tolist()
    data = out.tobytes()
    return [_header(int(k)) + data[a:b] for k, a, b in zip(sizes, [0, *stops], stops, strict=False)]


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """One stored form (a run of JPEG files) for each payload of a positive multiple of 64 bytes."""
    out: list[list[bytes]] = [[] for _ in payloads]
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        for (k, _), data in zip(held, _encode([a for _, a in held]), strict=True):
            out[k].append(data)

    for k, payload in enumerate(payloads):
        samples = np.frombuffer(payload, dtype=np.uint8)
        for i in range(0, len(samples), IMAGE_ROWS * ROW):
            held.append((k, samples[i : i + IMAGE_ROWS * ROW]))
            size += len(held[-1][1])
            if size >= BATCH:
                flush()
                held, size = [], 0
    if held:
        flush()
    return [b"".join(parts) for parts in out]


class Frame(NamedTuple):
    """What the markers of one image say; `scan` is its entropy-coded data."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    tables: tuple[tuple[bytes, bytes], ...]
    dc_step: int
    interval: int
    scan: bytes


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The image that starts at `at`, and where the next one starts."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG image here")
    at += 2
    quant: dict[int, int] = {}
    huff: dict[int, bytes] = {}
    interval, width, height = 0, 0, 0
    parts: list[tuple[int, int, int, int]] = []
    while True:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide])
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            height, width, n = struct.unpack(">HHB", body[1:6])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body)
        elif marker == 0xDA:
            used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG image")
    end = data.index(b"\xff\xd9", at)
    sampling = tuple((h, v) for _, h, v, _ in parts) if len(parts) > 1 else ((1, 1),)
    tables = tuple((huff[used[c] >> 4], huff[0x10 | used[c] & 15]) for c, *_ in parts)
    return Frame(width, height, sampling, tables, quant[parts[0][3]], interval, data[at : end + 2]), end + 2


_TABLES: dict[bytes, np.ndarray] = {}


def _table(spec: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code | symbol << 8."""
    if spec not in _TABLES:
        out = np.full(1 << 16, 1, dtype=np.int64)
        for symbol, (code, n) in _codes(list(spec[:16]), list(spec[16:])).items():
            out[code << (16 - n) : (code + 1) << (16 - n)] = n | symbol << 8
        _TABLES[spec] = out
    return _TABLES[spec]


def _lanes(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data without stuffing and markers as 40-bit words by byte, and each lane's start bit and image."""
    raw = np.frombuffer(b"".join(scans), dtype=np.uint8)
    at = np.flatnonzero(raw == 0xFF)
    following = raw[at + 1] if len(at) else at
    keep = np.ones(len(raw), dtype=bool)
    keep[at + 1] = False
    marks = at[following != 0]
    keep[marks] = False
    kept = np.cumsum(keep)
    ends = kept[marks]
    image_end = np.cumsum([len(s) for s in scans])
    starts = np.concatenate(([0], ends[:-1]))
    image = np.searchsorted(image_end, marks, side="right")
    data = np.concatenate((raw[keep], np.full(8, 0xFF, dtype=np.uint8))).astype(np.int64)
    n = len(data) - 4
    words = data[:n] << 32 | data[1 : n + 1] << 24 | data[2 : n + 2] << 16 | data[3 : n + 3] << 8 | data[4 : n + 4]
    return words, starts * 8, image


def _decode(frames: list[Frame]) -> list[np.ndarray]:
    """Thumbnails of images that share sampling, tables and restart interval."""
    model = frames[0]
    words, at, image = _lanes([f.scan for f in frames])
    across = [-(-f.width // (8 * model.sampling[0][0])) for f in frames]
    down = [-(-f.height // (8 * model.sampling[0][1])) for f in frames]
    n_mcus = np.array([a * d for a, d in zip(across, down, strict=True)])
    per_lane = model.interval or int(n_mcus.max())
    blocks = model.sampling[0][0] * model.sampling[0][1]
    out = np.zeros((per_lane * blocks, len(at)), dtype=np.int16)
    tables = [(_table(d), _table(a)) for d, a in model.tables]
    pred = [np.zeros(len(at), dtype=np.int64) for _ in tables]
    last = (len(words) - 1) * 8

    def bits(p: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (words[p >> 3] >> (40 - n - (p & 7))) & ((1 << n) - 1)

    for m in range(per_lane):
        for c, (h, v) in enumerate(model.sampling):
            dc, ac = tables[c]
            for b in range(h * v):
                code = dc[bits(at, 16)]
                at = at + (code & 0xFF)
                size = code >> 8
                value = bits(at, size)
                at = at + size
                pred[c] += np.where(value >> np.maximum(size - 1, 0) != 0, value, value - (1 << size) + 1)
                if c == 0:
                    out[m * blocks + b] = pred[0]
                code = ac[bits(at, 16)]
                at = at + (code & 0xFF) + (code >> 8 & 15)
                active = np.flatnonzero(code >> 8)
                k = 1 + (code[active] >> 12) + 1
                while len(active):
                    active, k = active[k < 64], k[k < 64]
                    code = ac[bits(at[active], 16)]
                    at[active] += (code & 0xFF) + (code >> 8 & 15)
                    more = code >> 8 != 0
                    active, k = active[more], k[more] + (code[more] >> 12) + 1
                np.minimum(at, last, out=at)
    h, v = model.sampling[0]
    first = np.searchsorted(image, np.arange(len(frames) + 1))
    out = np.ascontiguousarray(out.T)
    thumbs = []
    for f, a, d, i, j in zip(frames, across, down, first, first[1:], strict=False):
        dcs = out[i:j].reshape(-1, v, h)[: a * d].reshape(d, a, v, h).transpose(0, 2, 1, 3).reshape(d * v, a * h)
        samples = np.clip((dcs.astype(np.int32) * f.dc_step + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        thumbs.append(samples[: -(-f.height // 8), : -(-f.width // 8)])
    return thumbs


def thumbnails(stored: list[bytes]) -> list[list[np.ndarray]]:
    """The thumbnails of each stored form's images, decoded in batches of like images."""
    out: list[list[np.ndarray]] = [[] for _ in stored]
    waiting: dict[tuple, list[tuple[int, int, Frame]]] = {}
    held: dict[tuple, int] = {}

    def flush(key: tuple) -> None:
        batch = waiting.pop(key)
        held.pop(key)
        for (k, i, _), thumb in zip(batch, _decode([f for _, _, f in batch]), strict=True):
            out[k][i] = thumb

    for k, data in enumerate(stored):
        at = 0
        while at < len(data):
            frame, at = parse(data, at)
            key = (frame.sampling, frame.tables, frame.interval, None if frame.interval else (frame.width, frame.height))
            waiting.setdefault(key, []).append((k, len(out[k]), frame))
            out[k].append(np.zeros((0, 0), dtype=np.uint8))
            held[key] = held.get(key, 0) + len(frame.scan)
            if held[key] >= BATCH:
                flush(key)
    for key in list(waiting):
        flush(key)
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are above its mean."""
    rows = np.linspace(0, len(thumb), 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    np.cumsum(np.cumsum(thumb, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    top, bottom, left, right = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    bottom, right = np.minimum(bottom, thumb.shape[0]), np.minimum(right, thumb.shape[1])
    area = np.maximum(1, np.outer(bottom - top, right - left))
    cells = (total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]) / area
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
