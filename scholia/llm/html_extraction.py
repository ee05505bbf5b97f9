"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path (inline markup is not
part of a path).  Text length, punctuation and link text are aggregated by path, smoothed
over the page's order of blocks, fused into one score per path, and paths under a
threshold relative to the page's scores are left out.  Elements that never hold article
text (scripts, menus, forms, adverts, comments and so on, by tag or by a name in class, id
or role) are cut before.  A name that only begins with such a word ("ad-hoc") makes an
element suspect: its paths stand apart and have to reach the full bar.  Where the page marks
its article, only paths inside compete, against its middle score, and headings stay with the
content that they head.  Paths are whole, however deep: numbers stand for them.

Narrow: a scan and one Arrow stage, no exchange.  Defined results: null or empty html gives
an empty text; broken or cut markup is read as far as it goes; null ids and repeated rows
are kept row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。、，]")

#: Elements by their role in HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
CUT = frozenset("head nav footer aside form button select option svg canvas object audio video dialog menu".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)

#: Words of class, id and role that name what is not the article.
NOISE = frozenset(
    "ad ads advert advertisement advertisements adverts adsense banner breadcrumb breadcrumbs comment comments comment-list consent cookie "
    "cookies copyright disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promoted recommended related replies reply respond share sharing sidebar signup site-footer site-header skip social sponsor "
    "sponsored subscribe subscription tags teaser toolbar topbar tracking widget widgets complementary contentinfo search alert".split()
)
ARTICLE = frozenset("articlebody main".split())
#: Words among them that containers of the whole content bear too.  Such an element, or a
#: form, that holds most of the page's text is no noise.
SHARED_NAMES = frozenset("alert banner consent legal login modal notice popup promo search skip tags toolbar widget widgets".split())
#: Share of the text left by names that marked articles hold, from which the marks decide.
MARKED = 0.4

#: Spread of the smoothing over neighbouring blocks, and the share of the page's mean score
#: that a path has to reach; link text may be at most half of a path.
SIGMA = 1.0
THRESHOLD = 0.35
LINKS = 0.5

#: Inside a marked article, the share of its middle score (by characters, of a block at most
#: `WEIGHT`) that a path has to reach: a path that ends in a bare container, and any other.
#: Cells are short by nature and have no bar.
WEIGHT = 500
BARE_SHARE = 0.1
ARTICLE_SHARE = 0.02
BARE = frozenset("div section article main center header".split())
CELLS = frozenset("td th".split())

#: The share of the article's middle score that a suspect element's path has to reach.
SUSPECT_SHARE = 0.35


class Block(NamedTuple):
    """A text with the number of its path and of its parent's, and the path's last tag."""

    path: int
    parent: int
    tag: str
    suspect: bool
    text: str
    links: int
    in_article: bool
    heading: bool


def _named(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element's attributes name noise, noise by shared names only, only begin with such a word, or name the article."""
    hits: set[str] = set()
    hidden = suspect = article = False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            hidden = True
        if name not in ("class", "id", "role", "itemprop"):
            continue
        words = re.split(r"[\s_]+", (m[2] or m[3] or m[4] or "").lower())
        if name == "itemprop":
            article |= "articlebody" in words
        elif name == "role":
            article |= "main" in words
            hits.update(NOISE.intersection(words))
        else:
            # The last part of a name says what it is: a "page-footer" is one, "comment-policy" no comment.
            for w in words:
                parts = w.split("-")
                hits.update(NOISE.intersection((w, parts[-1])))
                suspect |= bool(NOISE.intersection(parts))
    noise = hidden or bool(hits)
    return noise, not hidden and hits <= SHARED_NAMES, suspect and not noise, article and not noise


def blocks(html: str) -> list[Block]:
    """Text blocks in page order, without those inside cut elements."""
    spared: set[int] = set()
    while True:
        out, most = _read(html, spared)
        if most is None:
            return out
        # An element that is noise by its kind or name alone, and holds most of the page's text.
        spared.add(most)


def _read(html: str, spared: set[int]) -> tuple[list[Block], int | None]:
    """The blocks, and the number of a cut element that should be `spared` as well."""
    out: list[Block] = []
    number, doubtful, lost = 0, 0, Counter()
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, cut, suspect, article, path
    paths: dict[tuple[int, str, bool], int] = {}
    open_of: Counter[str] = Counter()
    n_cut = n_suspect = n_article = n_heading = 0
    text: list[str] = []
    links = 0
    in_link = 0

    def enter(name: str, cut: bool, suspect: bool, article: bool) -> None:
        nonlocal n_cut, n_suspect, n_article, n_heading
        path = paths.setdefault((stack[-1][4] if stack else 0, name, suspect), len(paths) + 1)
        stack.append((name, cut, suspect, article, path))
        open_of[name] += 1
        n_cut, n_suspect, n_article, n_heading = n_cut + cut, n_suspect + suspect, n_article + article, n_heading + (name in HEADINGS)

    def leave() -> str:
        nonlocal n_cut, n_suspect, n_article, n_heading
        name, cut, suspect, article, _ = stack.pop()
        open_of[name] -= 1
        n_cut, n_suspect, n_article, n_heading = n_cut - cut, n_suspect - suspect, n_article - article, n_heading - (name in HEADINGS)
        return name

    def close() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            path, tag = (stack[-1][4], stack[-1][0]) if stack else (0, "")
            out.append(Block(path, stack[-2][4] if len(stack) > 1 else 0, tag, n_suspect > 0, joined, links, n_article > 0, n_heading > 0))
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece and not n_cut:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                links += len(piece.strip())
        elif piece:
            lost[doubtful] += len(piece.strip())

    at = 0
    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = 0
            if name in INLINE:
                continue
            close()
            if open_of[name]:
                while leave() != name:
                    pass
            continue
        if name == "a":
            in_link = 1
        if name == "br":
            text.append(" ")
        if name in INLINE or name in VOID:
            if name == "hr":
                close()
            continue
        close()
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if m[3].rstrip().endswith("/") and name not in ("script", "style"):
                continue
            at = end.start() if end else len(html)
            enter(name, True, False, False)
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            leave()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            leave()
        noise, shared, suspect, article = _named(m[3]) if m[3] else (False, True, False, False)
        cut = name in CUT or noise or (name == "header" and not n_article)
        number += 1
        if number in spared or noise and name in ("html", "body", "article", "main"):
            cut = False
        if cut and not n_cut:
            doubtful = number if shared and (name == "form" or name not in CUT and name != "header") else 0
        enter(name, cut, suspect, name in ("article", "main") or article)
    add(html[at:])
    close()
    element, size = max(((e, n) for e, n in lost.items() if e), key=lambda x: x[1], default=(None, 0))
    return out, element if 2 * size > sum(lost.values()) + sum(len(b.text) for b in out) else None


def _smooth(values: list[float]) -> list[float]:
    radius = math.ceil(2 * SIGMA)
    kernel = [math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, k in enumerate(kernel, -radius):
            if 0 <= i + d < len(values):
                total += k * values[i + d]
                weight += k
        out.append(total / weight)
    return out


def _article_share(tag: str, suspect: bool) -> float:
    return SUSPECT_SHARE if suspect else 0.0 if tag in CELLS else BARE_SHARE if tag in BARE else ARTICLE_SHARE


def _middle(weighted: list[tuple[float, int]]) -> float:
    """The score at which half of the weight lies."""
    left = sum(w for _, w in weighted) / 2
    for score, weight in sorted(weighted):
        left -= weight
        if left <= 0:
            return score
    return 0.0


def select(found: list[Block]) -> list[Block]:
    """The content blocks, by fused and smoothed ratios of their paths."""
    # Marked articles that hold little of the text (teasers beside it) are blocks like others.
    marked = sum(len(b.text) for b in found if b.in_article)
    if marked and marked >= MARKED * sum(len(b.text) for b in found):
        found = [b for b in found if b.in_article]
    else:
        found = [b._replace(in_article=False) for b in found]
    totals: dict[int, list[int]] = {}
    for b in found:
        t = totals.setdefault(b.path, [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(_PUNCTUATION.findall(b.text))
        t[3] += b.links
    length = {p: t[1] / t[0] for p, t in totals.items()}
    stops = {p: t[2] / t[0] for p, t in totals.items()}
    smooth_length = _smooth([length[b.path] for b in found])
    smooth_stops = _smooth([stops[b.path] for b in found])
    kinds = {b.path: (b.tag, b.suspect) for b in found}
    scores: dict[int, list[float]] = {}
    for b, x, y in zip(found, smooth_length, smooth_stops, strict=True):
        scores.setdefault(b.path, []).append(x * (1.0 + y))
    fused = {p: sum(s) / len(s) for p, s in scores.items()}
    bar = THRESHOLD * sum(fused[b.path] for b in found) / len(found) if found else 0.0
    linked = {p for p, t in totals.items() if t[3] > LINKS * t[1]}
    if any(b.in_article for b in found):
        # Neighbours lift a short block between long ones, so the path's own ratios count as much.
        fused = {p: math.sqrt(fused[p] * length[p] * (1.0 + stops[p])) for p in totals}
        middle = _middle([(fused[b.path], min(len(b.text), WEIGHT)) for b in found])
        kept = {p for p in totals if p not in linked and fused[p] >= _article_share(*kinds[p]) * middle}
    else:
        kept = {p for p in totals if p not in linked and fused[p] >= bar}
    homes = {b.parent for b in found if b.path in kept}
    return [b for b in found if b.path in kept or (b.heading and b.path not in linked and b.parent in homes)]


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in select(blocks(html or "")))


def extract_pages(df: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
