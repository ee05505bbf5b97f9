"""Functions for SQL: scalar ones as SQL expressions, table functions for use with LATERAL.

After `register(spark)`: `SELECT d.doc_id, c.* FROM documents d, LATERAL study_chunks(d.text) c`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import MAX_TOKENS, OVERLAP_TOKENS, chunk_text, estimate

_STRIP = r"regexp_replace({}, '(?U)^\\s+|\\s+$', '')"
#: Name -> (parameters, type, expression).
SCALARS = {
    "study_tokens": ("t STRING", "BIGINT", "greatest(1, length(t) DIV 4)"),
    "study_strip": ("t STRING", "STRING", _STRIP.format("t")),
    "study_paragraphs": ("t STRING", "ARRAY<STRING>", rf"filter(transform(split(t, '\\n{{2,}}'), x -> {_STRIP.format('x')}), x -> length(x) > 0)"),
    "study_sentences": ("t STRING", "ARRAY<STRING>", rf"filter(transform(split(t, '(?U)(?<=[.!?…])\\s+'), x -> {_STRIP.format('x')}), x -> length(x) > 0)"),
    "study_keywords": ("t STRING", "ARRAY<STRING>", r"array_distinct(filter(split(regexp_replace(lower(t), '[^a-z0-9\\s]', ' '), '\\s+'), w -> length(w) > 3))"),
    "study_headings": ("t STRING", "ARRAY<STRING>", rf"transform(regexp_extract_all(t, '(?m)^#{{1,6}}\\s+(.+)', 1), x -> {_STRIP.format('x')})"),
    "study_request_key": ("model STRING, prompt STRING", "STRING", r"sha2(concat(model, '\n', prompt), 256)"),
}


class Chunks:
    """The chunks of a text: position, content, n_tokens."""

    def eval(self, text: str | None, max_tokens: int | None = None, overlap_tokens: int | None = None) -> Iterator[tuple[int, str, int]]:
        for i, c in enumerate(chunk_text(text, MAX_TOKENS if max_tokens is None else max_tokens, OVERLAP_TOKENS if overlap_tokens is None else overlap_tokens)):
            yield i, c, estimate(c)


class Sections:
    """The second- and third-level sections of a Markdown text: section (from 1), title, body."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        import re

        number, title, body = 0, "", []
        for line in (text or "").split("\n"):
            if re.match(r"#{2,3}\s+\S", line):
                if number:
                    yield number, title, "\n".join(body).strip()
                number, title, body = number + 1, re.sub(r"^#{2,3}\s+", "", line).strip(), []
            elif number:
                body.append(line)
        if number:
            yield number, title, "\n".join(body).strip()


TABLES = {
    "study_chunks": (Chunks, "position int, content string, n_tokens long"),
    "study_sections": (Sections, "section int, title string, body string"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session and returns their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (cls, kind) in TABLES.items():
        spark.udtf.register(name, udtf(cls, returnType=kind))
    return [*SCALARS, *TABLES]
