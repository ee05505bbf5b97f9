"""Text functions as column expressions.

`(?U)` makes Java's classes cover all of Unicode, as the semantics ask for.  Expressions that
need Unicode normalisation live in `unicode`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SUFFIXES, SYLLABUS_WORDS

#: Patterns of PDF structure that leaks into a line, and of a line that is nothing else.
PDF_STRUCTURE = (
    r"(?i)startxref", r"%%EOF", r"\d+\s+\d+\s+obj\b", r"\bendobj\b", r"(?i)^stream$", r"(?i)^endstream$", r"(?i)^xref$",
    r"(?i)\btrailer\b", r"<<\s*/Type\s*/\w+", r"/Subtype\s*/\w+", r"/Filter\s*/\w+", r"/Width\s+\d+", r"/Height\s+\d+",
    r"/Length\s+\d+", r"/Root\s+\d+\s+\d+\s+R", r"/Info\s+\d+\s+\d+\s+R", r"/Type\s*/Page\b", r"/Type\s*/Catalog\b",
    r"/Type\s*/Font\b", r"/Type\s*/XObject\b", r"^\d+\s+\d+\s+\w+$",
)
#: A text without any of these in upper case, and without a line of the last pattern above, has no such line.
PDF_HINTS = ("XREF", "%%EOF", "OBJ", "STREAM", "TRAILER", "/TYPE", "/SUBTYPE", "/FILTER", "/WIDTH", "/HEIGHT", "/LENGTH", "/ROOT", "/INFO")
#: Patterns, whatever their case, of which three show an unparsed PDF.
PDF_MARKERS = (
    r"\bstartxref\b", r"%%EOF", r"\b\d+\s+\d+\s+obj\b", r"\bendobj\b", r"\bstream\b", r"\bendstream\b", r"\bxref\b",
    r"\btrailer\b", r"/Type\s*/\w+",
)
#: Topic names that name nothing.
EMPTY_NAMES = ("untitled", "no title", "n/a", "none", "")


def strip(c: Column) -> Column:
    """Both ends without Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def file_type(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.element_at(table, suffix), F.lit("unknown"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/?$", 1), r"(?<=.)\.[^.]*$", "")


def is_syllabus(path: Column, explicit: str | None = None) -> Column:
    named = reduce(lambda a, b: a | b, [F.contains(F.lower(file_stem(path)), F.lit(w)) for w in SYLLABUS_WORDS])
    return (path == F.lit(explicit)) | named if explicit else named


def normalize_lines(c: Column) -> Column:
    """Clean text: control characters, runs of blanks, line ends, PDF structure, blank runs."""
    text = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.regexp_replace(text, r"(?U)[^\S\n]+", " ")
    drop = "(?U)" + "|".join(f"(?:{p})" for p in PDF_STRUCTURE)
    # All white space but line ends is single spaces now, so plain trims do.
    trimmed = F.transform(lines(text), lambda x: F.trim(x))
    upper = F.upper(text)
    hinted = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(h)) for h in PDF_HINTS]) | text.rlike(r"(?mU)^ ?\d+ \d+ \w+ ?$")
    kept = F.when(hinted, F.filter(trimmed, lambda x: ~F.rlike(x, F.lit(drop)))).otherwise(trimmed)
    return F.btrim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: F.length(x) > 0)).cast("long")


def n_lines(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.regexp_count(c, F.lit("\n")) + 1).cast("long")


def token_count(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda x: F.length(x) > 0)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?…])\s+"), strip), lambda x: F.length(x) > 0)


def is_pdf_garbage(c: Column) -> Column:
    return reduce(lambda a, b: a + b, [c.rlike(f"(?iU){m}").cast("int") for m in PDF_MARKERS]) >= 3


def keywords(c: Column, longer_than: int = 3) -> Column:
    """Distinct lower-case words of letters a-z and digits over a length."""
    parts = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) > longer_than))


def space_keywords(c: Column, longer_than: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: F.length(w) > longer_than))


def is_invalid_name(c: Column) -> Column:
    name = F.lower(strip(F.coalesce(c, F.lit(""))))
    return name.rlike(r"^(topic|t)\s*\d+$") | name.isin(*EMPTY_NAMES) | (F.length(name) <= 1) | name.rlike(r"^\d+$")


def title(md: Column, default: str = "Untitled") -> Column:
    found = strip(F.regexp_extract(md, r"(?m)^#\s+(.+)", 1))
    return F.when(F.length(found) > 0, found).otherwise(F.lit(default))


def headings(md: Column) -> Column:
    return F.transform(F.regexp_extract_all(md, F.lit(r"(?m)^#{1,6}\s+(.+)"), F.lit(1)), strip)


def plain_text(md: Column) -> Column:
    """Markdown without its marks; emphasis goes before fences, so code stays as text."""
    for pattern, by in (
        (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"[*_`~]+", ""),
        (r"(?s)```.*?```", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"(?m)^-{3,}\s*$", ""),
    ):
        md = F.regexp_replace(md, pattern, by)
    return strip(md)


def without_artifacts(md: Column) -> Column:
    """Generated Markdown without lines that quote the prompt's own marks."""
    def keep(x: Column) -> Column:
        s = strip(x)
        return ~(s.startswith("[Chunk ") | s.rlike(r"^--- Source \d+ ---$") | (s == "[...]") | s.rlike(r"^#[a-z]\S* "))
    return F.array_join(F.filter(lines(md), keep), "\n")


def body_lines(md: Column, cuts: bool = False) -> Column:
    """Lines that carry content: no blanks, headings, rules, quotes, chunk marks nor (unless
    `cuts`) marks of a cut."""
    pattern = r"^$|^#{1,6}\s|^-{3,}$|^>|^\[Chunk " + ("" if cuts else r"|^\[\.\.\.\]$")
    return F.filter(lines(md), lambda x: ~strip(x).rlike(pattern))


def has_meaningful_content(md: Column, least: int = 3) -> Column:
    return F.size(body_lines(md, cuts=True)) >= least


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def prompt_key(model: Column, prompt: Column) -> Column:
    return sha256(F.concat(model, F.lit("\n"), prompt))


def stable_id(path: Column) -> Column:
    return F.substring(sha256(path), 1, 12)


def ascii_slug(c: Column) -> Column:
    """Slug of a text that holds ASCII only; `unicode.slug` folds accents first."""
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s-]+", "-"), r"^-+|-+$", "")


#: Output tokens of a chapter by depth.
DEPTH_TOKENS = {1: 8192, 2: 10240, 3: 14336, 4: 18432, 5: 22528, 6: 28672, 7: 36864, 8: 45056, 9: 53248, 10: 65536}
#: What each of the five bands of detail asks for.
DEPTH_TEXT = (
    "Short: the main ideas only.", "Concise: each idea with one example.", "Balanced: definitions, reasons and examples.",
    "Detailed: derivations, examples and frequent mistakes.", "Exhaustive: everything, with proofs, examples and questions with answers.",
)


def clamped_depth(level: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), level)).cast("int")


def depth_tokens(level: Column) -> Column:
    """Output tokens that a chapter of a depth may take."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in DEPTH_TOKENS.items() for x in pair]), clamped_depth(level))


def depth_instruction(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DEPTH_TEXT)), depth_band(level))


#: Suffixes that text recognition reads.
OCR_SUFFIXES = ("png", "jpg", "jpeg")


def is_ocr_image(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1).isin(*OCR_SUFFIXES)


def encode_image(content: Column) -> Column:
    """Base64 in one line, as a model's request holds it."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def depth_band(level: Column) -> Column:
    """One of five bands of detail for a depth of 1 to 10."""
    return F.ceil(F.greatest(F.lit(1), F.least(F.lit(10), level)) / 2).cast("int")


def context_budget(prompt: Column, predict: Column, least: int = 8192, most: int = 131072) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.length(prompt) / 4) + predict + 4096)).cast("long")


def image_paths(md: Column, folder: str = "output/") -> Column:
    """Relative image targets moved under the output folder."""
    return F.regexp_replace(md, rf"!\[([^\]]*)\]\((?!https?://|{folder})([^)]+)\)", f"![$1]({folder}$2)")
