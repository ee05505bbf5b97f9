"""Token ids of whole texts by a public byte-level BPE vocabulary.

The tokenizers library encodes; a bounded cache keeps the ids of the pieces between
spaces.  Cutting before a space that follows a character other than white space is safe:
no pre-token of the byte-level pattern holds white space after another character.
Texts where a space follows white space go to the library whole, and so do texts that hold
an added token, which the library recognises before it cuts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Id that ends every document.
END_ID = 0
#: Name of the vocabulary among the public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker's cache keeps; beyond it, pieces are encoded each time.
CACHE_PIECES = 700_000

_UNSAFE = re.compile(r"\s ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes lists of texts to arrays of uint32 ids that end with `END_ID`."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What reaches the library is new to this cache, so the library's own need not be large.
        self.tokenizer.model._resize_cache(1000)
        self.cache: dict[str, bytes] = {}
        self.marks = dict(zip(",.", self._library([",", "."]), strict=True))
        # Byte-level tokens: one character of the token's name stands for one byte.
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for name, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(name)
        self.cache_pieces = cache_pieces
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, dtype="<u4").tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that each follow a space, encoded a few hundred to a call.

        Where a piece ends in the ids follows from the tokens' known lengths in bytes.
        """
        out: dict[str, bytes] = {}
        alone = [p for p in pieces if p[-1:].isspace() or not p]
        out.update(zip(alone, self._library([" " + p for p in alone]), strict=True))
        joined = [p for p in pieces if p not in out]
        parts = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        for part, blob in zip(parts, self._library([" " + " ".join(p) for p in parts]) if parts else (), strict=True):
            ids = np.frombuffer(blob, dtype="<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in part])
            cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * 4
            start = 0
            for p, stop in zip(part, cuts.tolist(), strict=True):
                out[p] = blob[start:stop]
                start = stop
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cache = self.cache
        found: list[list[bytes | None] | None] = []
        missing: list[tuple[int, int, str, bytes]] = []
        whole: list[str] = []
        firsts: list[str] = []
        for t in texts:
            t = t or ""
            if t.startswith(" ") or _UNSAFE.search(t) or any(a in t for a in self.added):
                found.append(None)
                whole.append(t)
                continue
            pieces = t.split(" ")
            firsts.append(pieces[0])
            ids = list(map(cache.get, pieces))
            ids[0] = b""
            if None in ids:
                k = len(found)
                for i in [i for i, got in enumerate(ids) if got is None]:
                    # A mark after a letter starts a token of its own.
                    p = pieces[i]
                    mark = self.marks.get(p[-1:]) if p[-2:-1].isalpha() else None
                    if mark is None:
                        missing.append((k, i, p, b""))
                    elif (got := cache.get(p[:-1])) is not None:
                        ids[i] = got + mark
                        if len(cache) < self.cache_pieces:
                            cache[p] = ids[i]
                    else:
                        missing.append((k, i, p[:-1], mark))
            found.append(ids)
        known = self._pieces(list({p for _, _, p, _ in missing}))
        for k, i, p, mark in missing:
            found[k][i] = known[p] + mark
        for p in list(known)[: max(0, self.cache_pieces - len(cache))]:
            cache[p] = known[p]
        encoded = iter(self._library(whole) if whole else ())
        lead = iter(self._library(firsts) if firsts else ())
        end = np.uint32(END_ID).astype("<u4").tobytes()
        return [
            np.frombuffer((next(encoded) if ids is None else next(lead) + b"".join(ids)) + end, dtype="<u4") for ids in found
        ]


@lru_cache(maxsize=1)
def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, cache_pieces)
