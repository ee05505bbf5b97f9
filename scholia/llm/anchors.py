"""Content-defined segments of texts, and the hashes that identify their parts.

A window is a string of `WINDOW` bytes.  Its anchor value is the least hash of the `GRAM`-byte
strings in it, so equal windows have equal anchor values wherever they stand.  Consecutive
windows with one anchor value form a segment (of at most `SPAN` windows).  Every window lies
in exactly one segment, and a text has about 2 / SPAN segments a byte.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
GRAM = 32
SPAN = WINDOW - GRAM + 1

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_M64 = (1 << 64) - 1


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES, _BYTES2 = _table(1), _table(2)


class Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))))
        return self.up, self.down


_POWERS, _POWERS2 = Powers(_BASE), Powers(_BASE2)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix polynomial hashes of a byte array: the hash of any span in two reads."""

    def __init__(self, data: np.ndarray, second: bool = False):
        self.up, self.down = (_POWERS2 if second else _POWERS).get(len(data) + 1)
        table = _BYTES2 if second else _BYTES
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * self.up[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by block-wise running minima from both sides."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, repeats, anchor value, content hash) of every segment.

    `repeats` tells segments whose anchor occurs twice: only they may hold a window twice.
    """
    sizes = np.array([len(t) for t in texts])
    empty = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    if not len(sizes) or sizes.max() < WINDOW:
        return empty
    long = np.flatnonzero(sizes >= WINDOW)
    data = np.frombuffer(b"".join([texts[i] for i in long.tolist()]), dtype=np.uint8)
    ends = np.cumsum(sizes[long])
    first = ends - sizes[long]
    prefix = Prefix(data)
    n = len(data) - GRAM + 1
    grams = mix((prefix.sums[GRAM:] - prefix.sums[:n]) * prefix.down[:n])
    least = sliding_min(grams, SPAN)
    valid = np.ones(len(least), dtype=bool)
    # Windows that would cross into the next text.
    for e in ends[:-1].tolist():
        valid[e - WINDOW + 1 : e] = False
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new & valid)
    bounds = np.append(starts, len(least))
    stop = np.minimum(bounds[1:], ends[np.searchsorted(ends, starts, side="right")] - WINDOW + 1)
    count = stop - starts
    # Runs over SPAN windows (texts that repeat themselves) are cut.
    parts = -(-count // SPAN)
    if parts.max() > 1:
        which = np.repeat(np.arange(len(starts)), parts)
        k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, count = starts[which] + k * SPAN, np.minimum(SPAN, count[which] - k * SPAN)
    second = Prefix(data, second=True)
    content = mix(second.span(starts, starts + count + WINDOW - 1) + count.astype(np.uint64))
    # Grams that are the least of some window, and those among them that equal the one before.
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    most = ~sliding_min(~np.concatenate((edge, least, edge)), SPAN)
    chosen = np.flatnonzero(grams == most)
    again = chosen[1:][(grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) < SPAN)]
    seen = np.zeros(n + 1, dtype=np.int32)
    seen[again + 1] = 1
    np.cumsum(seen, out=seen)
    repeats = (seen[starts + count + SPAN - 1] > seen[starts + 1]).astype(np.int64)
    text = np.searchsorted(ends, starts, side="right")
    return long[text], starts - first[text], count, repeats, least[starts], content
