"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (`letter_counts`): a table of
   at most 64 ** 3 sums, whatever the corpus.
2. Every text is restored: tokens with look-alike characters, repeated letters or letters
   set apart become character lattices, and Viterbi decoding under the model and the
   channel's costs gives their likeliest readings.
3. Words of restored texts that tell labelled toxic rows from clean ones become rules, from
   a bounded sample of the labelled rows that are not held out.
   Copies of a text, and near copies whose min-hashes all agree, count once as support.
4. A document's score is the noisy-or of the rules that its restored text fires.

Scoring is a scan with two broadcasts of proven size (the model, and rules that at least
`LEAST_SUPPORT` rows of a sample of `SAMPLE_ROWS` hold); no text is shuffled.

Defined results: null and empty texts fire nothing and get the base score; null ids are
never held out nor learned from; labels of null are left out; repeated rows are scored row
by row; without any toxic label every document gets the base score of 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Labelled rows that rules are learned from (the ones with the smallest hash), the least
#: number of different toxic texts that support a rule, and its least precision.
SAMPLE_ROWS = 20_000
LEAST_SUPPORT = 5
LEAST_PRECISION = 0.9
HELD_OUT = 2
PREDICT_AT = 0.3
#: Independent min-hashes that near copies share: unrelated texts at Jaccard 0.5 meet once in 256.
MIN_HASHES = 8

#: Letters of the model; place 0 is any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
_SIZE = 64

#: What characters stand for in disguised words.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
_SEPARATORS = ".-_*~ /\\'^,:;#%&=\"<>)[]{}?"
_EDGE = ".,;:!?\"'()[]{}<>*%&#$|~_-=/\\…¡¿«»“”‘’"
_MARKS = "".join(c for c in _EDGE if c not in LOOK_ALIKE)

#: Channel costs in nats: a look-alike, a look-alike or a stray mark that stands for nothing,
#: a mark that parts words, each further copy in a stretched letter, and a double one for one.
COST_LOOK, COST_LOST, COST_DROP, COST_PART, COST_STRETCH, COST_DOUBLE = 0.7, 10.0, 1.5, 4.0, 0.3, 4.0
READINGS = 4

_DOUBLED = re.compile(r"([^\W\d_])\1")
_RUNS = re.compile(r"(.)\1+", re.S)
_APART = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|])){3,}(?![^\W_])")


def _codes() -> np.ndarray:
    table = np.zeros(0x180, dtype=np.int64)
    for i, c in enumerate(LETTERS, 1):
        table[ord(c)] = i
    return table


_CODES = _codes()
_CODE_OF = {c: i for i, c in enumerate(LETTERS, 1)}


def letter_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts, as an array [64, 64, 64]."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                joined = "  ".join(t for t in batch.column(0).slice(i, 256).to_pylist() if t).lower()
                points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
                codes = _CODES[np.where(points < len(_CODES), points, 0)]
                total += np.bincount(codes[:-2] * _SIZE**2 + codes[1:-1] * _SIZE + codes[2:], minlength=_SIZE**3) if len(codes) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    grams = df.select(F.col(text).alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(_SIZE**3)
    for row in grams.collect():  # at most 64 ** 3 rows
        out[row["gram"]] = row["n"]
    return out.reshape(_SIZE, _SIZE, _SIZE)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a letter after two, interpolated with shorter contexts."""
    uni = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + _SIZE)
    pairs = counts.sum(axis=0)
    bi = (pairs + 5 * uni) / (pairs.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 5 * bi[None]) / (counts.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def _arcs(token: str, apart: bool) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of a character, what it may stand for and at which cost."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        arcs: list[tuple[str, float]] = []
        letters = c if c in _CODE_OF or c.isalpha() else LOOK_ALIKE.get(c, "")
        look = 0.0 if letters == c else COST_LOOK
        for x in letters:
            arcs.append((x, look + (COST_DOUBLE if n == 2 else COST_STRETCH * (n - 1))))
            if n >= 2:
                arcs.append((x * 2, look + COST_STRETCH * (n - 2)))
        if letters != c:
            arcs.append(("", 0.1 if apart and c in _SEPARATORS else COST_LOST * n if letters else COST_DROP))
            arcs.append((" ", COST_PART))
        out.append(arcs)
        i = j
    return out


def decode(token: str, model: np.ndarray, apart: bool = False, readings: int = READINGS) -> list[tuple[str, float]]:
    """The likeliest readings of a lower-case token and their shares of the likelihood."""
    beam: dict[tuple[int, int], list[tuple[float, tuple]]] = {(0, 0): [(0.0, ())]}
    for arcs in _arcs(token, apart):
        grown: dict[tuple[int, int], list[tuple[float, tuple]]] = {}
        for (a, b), paths in beam.items():
            for out, cost in arcs:
                x, y, gain = a, b, -cost
                for c in out:
                    z = _CODE_OF.get(c, 0)
                    gain += float(model[x, y, z])
                    x, y = y, z
                grown.setdefault((x, y), []).extend((s + gain, (t, out)) for s, t in paths)
        # A state keeps its best paths: nothing after it depends on more than two letters.
        beam = {state: sorted(paths, key=lambda p: -p[0])[:readings] for state, paths in grown.items()}
    ended = [(s + float(model[a, b, 0]), t) for (a, b), paths in beam.items() for s, t in paths]
    best: dict[str, float] = {}
    for s, path in sorted(ended, key=lambda p: -p[0]):
        parts = []
        while path:
            path, out = path
            parts.append(out)
        best.setdefault(" ".join("".join(reversed(parts)).split()), s)
        if len(best) == readings:
            break
    top = max(best.values())
    total = sum(np.exp(s - top) for s in best.values())
    return [(t, float(np.exp(s - top) / total)) for t, s in best.items()]


def _forms(token: str) -> set[str]:
    """A token without its edges, and with those of its edge marks that may stand for letters."""
    core = token.strip(_EDGE)
    if not core:
        return set()
    at = token.index(core)
    left = token[:at].lstrip(_MARKS)
    right = token[at + len(core) :].rstrip(_MARKS)
    return {a + core + b for a in {"", left} for b in {"", right}}


def _squeezed(word: str) -> str:
    """A word with each run of a letter as one."""
    return _RUNS.sub(r"\1", word)


class Restorer:
    """Restores texts; keeps the readings of tokens seen before, up to a bound.

    With `words`, tokens of letters only are decoded if some way to halve or double their
    letters gives one of these words; the readings of others could not hold one.
    """

    def __init__(self, model: np.ndarray, words: Iterable[str] | None = None, kept: int = 100_000):
        self.model, self.kept = model, kept
        self.words = None if words is None else {_squeezed(w) for w in words}
        self.seen: dict[str, list[tuple[str, float]]] = {}

    def readings(self, token: str) -> list[tuple[str, float]]:
        """Readings of a token between white space; none if it is not disguised."""
        found = self.seen.get(token)
        if found is None:
            found = []
            if not token.isalpha() or _DOUBLED.search(token):
                for form in _forms(token):
                    if self.tells(form):
                        found += decode(form, self.model)
            if len(self.seen) < self.kept and len(token) < 100:
                self.seen[token] = found
        return found

    def tells(self, form: str) -> bool:
        """Whether a form is disguised and its readings matter."""
        if form.isalpha():
            return bool(_DOUBLED.search(form)) and (self.words is None or _squeezed(form) in self.words)
        return any(map(str.isalpha, form))

    def __call__(self, text: str) -> tuple[str, list[tuple[str, float]]]:
        """The lower-case text, and readings of its disguised tokens with their shares."""
        lower = text.lower()
        found = [x for token in set(lower.split()) for x in self.readings(token)]
        for m in _APART.finditer(lower):
            found += decode(m[0], self.model, apart=True)
        return lower, found


class Rule(NamedTuple):
    """A word and how sure it is."""

    text: str
    precision: float


_WORD = re.compile(r"[^\W\d_]+")


def _features(restore: Restorer, text: str) -> set[str]:
    """The words of a restored text."""
    lower, found = restore(text)
    words = set(_WORD.findall(lower)).union(*(_WORD.findall(t) for t, share in found if share >= 0.5))
    return {w for w in words if len(w) > 1}


#: Odd factors of the min-hashes; all of them have to agree in near copies.
_FACTORS = np.random.default_rng(1).integers(0, 2**63, MIN_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def kind_of(features: list[str]) -> bytes:
    """The least hashes of a set: equal in copies, and in near copies at Jaccard ** MIN_HASHES."""
    if not features:
        return b""
    marks = np.array([zlib.crc32(f.encode("utf-8", "replace")) + 1 for f in features], dtype=np.uint64)
    mixed = marks[:, None] * _FACTORS[None]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).min(axis=0).tobytes()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def learn_rules(docs: DataFrame, labels: DataFrame, model: np.ndarray, *, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rule list, from at most `sample_rows` labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [sorted(_features(restore, t or "")) for t in part.column(0).to_pylist()]
                kinds = pa.array([kind_of(f) for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), kinds, pa.array(found, pa.list_(pa.string()))], names=["toxic", "kind", "features"])

    # Copies and near copies are of one kind, so they support a rule once.
    kinds = Workspace(docs.sparkSession).save(rows.mapInArrow(extract, "toxic int, kind binary, features array<string>"), "labelled")
    single = kinds.select("toxic", "kind", F.explode("features").alias("f")).distinct()
    counts = single.groupBy("f").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    sure = (F.col("pos") >= LEAST_SUPPORT) & (F.col("pos") >= LEAST_PRECISION * (F.col("pos") + F.col("neg")))
    good = counts.where(sure).orderBy(F.desc("pos"), "neg", "f").collect()
    return [Rule(r["f"], (r["pos"] + 0.5) / (r["pos"] + r["neg"] + 1)) for r in good]


class Matcher:
    """Finds the rules whose words a text holds; keeps what it found in short texts, up to a bound."""

    def __init__(self, rules: list[Rule], kept: int = 200_000):
        self.places = {r.text: k for k, r in enumerate(rules)}
        self.kept = kept
        self.seen: dict[str, set[int]] = {}

    def __call__(self, text: str) -> set[int]:
        found = self.seen.get(text)
        if found is None:
            found = {self.places[w] for w in set(_WORD.findall(text)) & self.places.keys()}
            if len(self.seen) < self.kept and len(text) < 100:
                self.seen[text] = found
        return found


def score_text(text: str, restore: Restorer, matcher: Matcher, rules: list[Rule], base: float = 0.01) -> float:
    """Noisy-or of fired rules; a rule read from a disguised token counts by the reading's share."""
    if not rules:
        return 0.0
    lower, found = restore(text)
    miss = {k: 1.0 - rules[k].precision for k in matcher(lower)}
    shares: dict[int, float] = {}
    for reading, share in found:
        for k in matcher(reading):
            shares[k] = min(1.0, shares.get(k, 0.0) + share)
    for k, share in shares.items():
        miss[k] = min(miss.get(k, 1.0), 1.0 - rules[k].precision * share)
    left = 1.0 - base
    for m in miss.values():
        left *= m
    return 1.0 - left


def toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = letter_model(letter_counts(docs))
    rules = learn_rules(docs, labels.select("doc_id", "toxic"), model, sample_rows=sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, matcher = Restorer(model, (r.text for r in rules)), Matcher(rules)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                scores = [score_text(t or "", restore, matcher, rules) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).alias("predicted"),
    )
