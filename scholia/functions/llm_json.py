"""Reading JSON that a language model wrote, with repairs from cheap to costly."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(c: Column) -> Column:
    """Backslashes that start no JSON escape are dropped; an escaped backslash is one of two."""
    return F.regexp_replace(c, r'(\\["\\/bfnrtu])|\\([^\n])', "$1$2")


def unfenced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*", ""), r"(?s)\s*```\s*$", "")


def parse_json(c: Column, schema: str) -> Column:
    """The response as a struct: as it is, sanitised, between its outer braces, else repaired."""
    body = sanitize(unfenced(c))
    outer = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    read = lambda x: F.from_json(x, schema)
    tried = [F.when(F.try_parse_json(x).isNotNull(), read(x)) for x in (unfenced(c), body, outer)]
    return F.coalesce(*tried, read(repair(body)))


def _close(text: str) -> str | None:
    """The longest beginning that ends after a closing bracket and parses once all are closed."""
    stack, inside, escaped, ends = [], False, False, []
    for i, ch in enumerate(text):
        if inside:
            escaped, inside = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
            continue
        if ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            ends.append((i + 1, "".join(reversed(stack))))
    for end, tail in reversed(ends):
        try:
            json.loads(text[:end] + tail)
            return text[:end] + tail
        except ValueError:
            continue
    return None


def markdown_outline(text: str) -> str | None:
    """An outline written as headings and lists, as the JSON that was asked for."""
    chapters: list[dict] = []
    for line in text.split("\n"):
        if m := re.match(r"^\s*(?:#{1,4}\s*)?(?:\*\*)?(?:Chapter|Capitolo)\s+\d+\s*[:.\-]\s*(.+?)(?:\*\*)?\s*$", line, re.I):
            chapters.append({"title": m[1].strip(), "sections": []})
        elif chapters and (m := re.match(r"^\s*(?:\d+(?:\.\d+)*[.)]?|[-*+])\s+(.+)$", line)):
            chapters[-1]["sections"].append(m[1].strip())
    found = [c for c in chapters if c["sections"]]
    return json.dumps({"chapters": found}) if found else None


def _repair(text: str | None) -> str | None:
    if not text:
        return None
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    return (_close(text[start:]) if start >= 0 else None) or markdown_outline(text)


def _repairs(texts: pd.Series) -> pd.Series:
    return texts.map(_repair)


def repair(c: Column) -> Column:
    """Cut-off JSON closed, or a Markdown outline turned into JSON; else null."""
    return F.pandas_udf(_repairs, "string")(c)


def loads(text: str) -> object:
    """A response's JSON as Python values, read as `parse_json` reads it, or ValueError."""
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    clean = re.sub(r"\\(.)", lambda m: m[0] if m[1] in '"\\/bfnrtu' else m[1], bare)
    outer = re.search(r"\{.*\}", clean, re.S)
    for tried in (bare, clean, outer[0] if outer else "", _repair(clean) or ""):
        try:
            return json.loads(tried)
        except ValueError:
            continue
    raise ValueError("no JSON in the response")


def has_body(md: str, least: int = 3) -> bool:
    """Whether enough lines are more than headings, rules, quotes and chunk marks."""
    lines = (x.strip() for x in md.split("\n"))
    return sum(bool(x) and not re.match(r"#{1,6}\s|-{3,}$|>|\[Chunk ", x) for x in lines) >= least


TOPICS = "struct<topics:array<struct<name:string,description:string,related_documents:array<string>,chunk_ids:array<string>,subtopic_count:int,order_source:string,syllabus_position:int>>>"
OUTLINE = "struct<chapters:array<struct<title:string,sections:array<string>>>>"
CHAPTER = "struct<title:string,content:string,sections:array<string>>"
RELEVANCE = "struct<relevant:boolean,position:string,reason:string>"
