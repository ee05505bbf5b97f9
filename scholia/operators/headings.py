"""Aligning a generated chapter's headings with the sections that were asked for.

A chapter is one short document, so the three passes run in one Python call per row.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English and Italian function words left out of comparisons.
FUNCTION_WORDS = frozenset(
    "the a an and or but in on at to for of by with from as is are was were be been being have has had do does did will would "
    "can could shall should may might this that these those it its they them their we our you your he she him her his not no "
    "nor all each every some any both few more most other into over such than then just about also very chapter section part "
    "di del della delle dei dello degli dal dalla dai dalle il lo la le gli un una uno con per su tra fra in nel nella nei "
    "nelle allo alla agli alle col coi sul sulla sui che e ed o senza non come quale quali da ai al".split()
)
#: Words of headings that an outline does not have, and signs of them.
DECORATION = frozenset(
    "notes note references reference resources resource bibliography sources source conclusione conclusion riepilogo summary "
    "recap takeaways keytakeaways appendix appendice tableofcontents indice toc".split()
)
DECORATION_SIGNS = "📝🔗📚🟡📌ℹ"
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
LEAST_OVERLAP, LEAST_LIKENESS = 0.5, 0.40


def key(text: str) -> str:
    """Letters and digits without accents and leading digits."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "", plain).lstrip("0123456789")


def words(text: str) -> set[str]:
    return {w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) > 2} - FUNCTION_WORDS


def overlap(a: str, b: str) -> float:
    x, y = words(a), words(b)
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def likeness(a: str, b: str) -> float:
    x, y = key(a), key(b)
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def is_decorative(text: str) -> bool:
    return set(re.findall(r"[a-z]{3,}", text.lower())) <= DECORATION or any(c in text for c in DECORATION_SIGNS)


def _decorative(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else is_decorative(t))


def decorative(text: Column | str) -> Column:
    return F.pandas_udf(_decorative, "boolean")(text)


def align(md: str | None, title: str | None, sections: list[str] | None) -> str | None:
    """The chapter with its first heading as title and its section headings renamed."""
    if md is None:
        return None
    lines = md.split("\n")
    found = [(i, m[1], m[2]) for i, line in enumerate(lines) if (m := _HEADING.match(line))]
    if not found or title is None:
        return md
    new: dict[int, str] = {found[0][0]: title}
    # A heading that repeats the title is no section.
    heads = {i: text for i, _, text in found[1:] if not key(title) or key(text) != key(title)}
    free = dict(enumerate(sections or []))
    for i, text in heads.items():
        best = max(free, key=lambda s: overlap(text, free[s]), default=None)
        if best is not None and overlap(text, free[best]) >= LEAST_OVERLAP:
            new[i] = free.pop(best)
    left = {i: text for i, text in heads.items() if i not in new and not is_decorative(text)}
    if free and len(left) == len(free):
        # As many headings as sections: in order, if anything shows that they are translations.
        if any(overlap(h, s) > 0 or likeness(h, s) >= LEAST_LIKENESS for h in left.values() for s in free.values()):
            new |= dict(zip(left, free.values(), strict=True))
    elif len(left) > len(free) > 0:
        scores = ((max(overlap(h, s), likeness(h, s)), i, k) for i, h in left.items() for k, s in free.items())
        for score, i, k in sorted(scores, key=lambda x: -x[0]):
            if score >= LEAST_LIKENESS and i not in new and k in free:
                new[i] = free.pop(k)
    for i, mark, _ in found:
        if i in new:
            lines[i] = f"{mark} {new[i]}"
    return "\n".join(lines)


def _aligned(md: pd.Series, title: pd.Series, sections: pd.Series) -> pd.Series:
    return pd.Series([align(m, t, None if s is None else list(s)) for m, t, s in zip(md, title, sections, strict=True)], dtype=object)


def align_headings(md: Column, title: Column, sections: Column) -> Column:
    return F.pandas_udf(_aligned, "string")(md, title, sections)


def missing_sections(md: str, sections: list[str]) -> list[str]:
    have = {key(m[2]) for line in md.split("\n") if (m := _HEADING.match(line))}
    return [s for s in sections if key(s) not in have]
