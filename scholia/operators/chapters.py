"""Writing chapters with a model: prompts, attempts with feedback, and what follows an accepted text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import llm_json as J
from ..functions import text as T
from . import headings
from .generation import BadResponse, GenerationError

ATTEMPTS, GROWTH, MOST_TOKENS = 5, 1.5, 196608
IMAGES_PER_CHAPTER, CANDIDATES = 3, 15
#: A provider of chapters: (prompt, tokens for the answer) -> response.
Ask = Callable[[str, int], str]


class ChapterError(Exception):
    """No attempt gave a usable chapter."""


def read_chapter(response: str) -> dict:
    """Title, content and sections of a response, or BadResponse."""
    try:
        found = J.loads(response)
    except ValueError as e:
        raise BadResponse(str(e)) from e
    if not isinstance(found, dict) or not {"title", "content"} <= set(found):
        raise BadResponse("no JSON with title and content")
    sections = found.get("sections") if isinstance(found.get("sections"), list) else []
    return {"title": str(found["title"]).strip(), "content": str(found["content"]).strip(), "sections": [str(s) for s in sections]}


def problems_of(chapter: dict, sections: list[str]) -> list[str]:
    """What keeps a chapter from being accepted."""
    out = [] if J.has_body(chapter["content"]) else ["The content has headings without paragraphs."]
    lost = headings.missing_sections(chapter["content"], sections)
    return out + ([f"These section headings are missing: {'; '.join(lost)}."] if lost else [])


def write_chapter(ask: Ask, prompt: str, tokens: int, title: str | None, sections: list[str] | None) -> tuple[dict, int]:
    """(accepted chapter, attempts).  A failed answer is asked for again with what was wrong;
    only an answer that is no JSON gets more tokens."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            chapter = read_chapter(ask(prompt, tokens))
            if title is not None:
                chapter["content"] = headings.align(chapter["content"], title, sections)
            wrong = problems_of(chapter, sections or [] if title is not None else [])
            if not wrong:
                return chapter, attempt
        except BadResponse as e:
            wrong, tokens = [f"The answer was not usable: {e}."], min(int(tokens * GROWTH), MOST_TOKENS)
        except GenerationError as e:
            wrong = [f"The request failed: {e}."]
        plan = "" if title is None else f"\nUse exactly this title and these headings.\nTitle: {title}\n" + "\n".join(f"{i}. {s}" for i, s in enumerate(sections or [], 1))
        prompt += "\n\nThe last answer had errors. " + " ".join(wrong) + " Give the whole corrected JSON, with paragraphs under every heading." + plan
    raise ChapterError(f"no usable chapter after {ATTEMPTS} attempts: {' '.join(wrong)}")


def generate_chapters(prompts: DataFrame, ask: Ask) -> DataFrame:
    """Rows (ord, title, content, sections, attempts, error) from rows (ord, prompt, depth, title, sections);
    the last two are the outline's, or null."""
    schema = "ord long, title string, content string, sections array<string>, attempts int, error string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tokens = T.DEPTH_TOKENS[max(1, min(10, r["depth"]))]
                try:
                    ch, n = write_chapter(ask, r["prompt"], tokens, r["title"], r["sections"])
                    kept = (ch["title"], ch["sections"]) if r["title"] is None else (r["title"], r["sections"] or [])
                    out.append((r["ord"], kept[0], ch["content"], kept[1], n, None))
                except ChapterError as e:
                    out.append((r["ord"], r["title"], None, r["sections"], ATTEMPTS, str(e)[:500]))
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    rows = prompts.select(F.col("ord").cast("long").alias("ord"), "prompt", F.col("depth").cast("int").alias("depth"), "title", "sections")
    written = rows.mapInArrow(write, schema)
    return written.withColumn("content", T.without_artifacts(F.col("content")))


def placeholder(name: Column, description: Column) -> Column:
    """The chapter of a topic that the notes do not hold."""
    asked = F.when(F.length(F.coalesce(description, F.lit(""))) > 0, description).otherwise(name)
    return F.concat(
        F.lit("## "), name, F.lit("\n\n> **Note:** This topic belongs to the syllabus, but the notes hold nothing about it. Please see the "
                                "course material for it.\n\n### Topics to study\n\n"), asked, F.lit("\n"))


def with_banner(content: Column, extra: Column) -> Column:
    """A chapter with a note in front if its topic is not in the syllabus."""
    note = F.lit("> **Note:** This topic is in the notes but not in the official syllabus; it is included for completeness.\n\n")
    return F.when(F.coalesce(extra, F.lit(False)), F.concat(note, content)).otherwise(content)


def images_of_topics(topics: DataFrame, candidates: DataFrame, no_images: bool = False) -> DataFrame:
    """Images (id, source_document_id, ...) of the documents that topics (ord, related_documents) name."""
    named = topics.select("ord", F.explode("related_documents").alias("source_document_id")).distinct()
    return candidates.join(named, "source_document_id").where(~F.lit(no_images))


def select_images(draft: str, candidates: list[dict], describe: Callable[[dict], str], relevant: Ask, most: int = IMAGES_PER_CHAPTER) -> list[tuple[dict, str]]:
    """(image, placement) of a chapter's images: described ones first, up to `CANDIDATES` are
    asked about until `most` are found; a failing image is left out."""
    described = [c for c in candidates if c.get("ai_description")]
    rest = [c for c in candidates if not c.get("ai_description")][: max(0, CANDIDATES - len(described))]
    found: list[tuple[dict, str]] = []
    for image in (described + rest)[:CANDIDATES]:
        if len(found) == most:
            break
        text = image.get("ai_description") or describe(image)
        if not text:
            continue
        try:
            answer = J.loads(relevant(relevance_prompt(draft, text), 1024))
        except (GenerationError, ValueError):
            continue
        if isinstance(answer, dict) and answer.get("relevant"):
            found.append((image, answer.get("placement") or "before conclusion"))
    return found


def relevance_prompt(draft: str, description: str) -> str:
    return ("Does this image belong into the chapter? Answer as JSON {relevant, placement}; the placement names a heading or \"before conclusion\".\n"
            f"Image: {description}\nChapter:\n{draft}")


def description_prompt(caption: str) -> str:
    return f"Describe what this image of study material shows in two or three sentences. Its caption: {caption or 'none'}."


def focus_prompt(name: Column, material: Column, sources: Column, depth: Column) -> Column:
    """The prompt of a manual on one topic."""
    return F.concat(
        F.lit("Write all that the material says about one topic in Markdown as JSON {title, content, sections}.\nTopic: "), name,
        F.lit("\n"), T.depth_instruction(depth), citations(sources), F.lit("\nMaterial:\n"), material)


def relevant_chunks_prompt(name: Column, material: Column) -> Column:
    return F.concat(F.lit("Which of these chunks are about the topic? Answer as JSON {chunk_ids}.\nTopic: "), name, F.lit("\nChunks:\n"), material)


def citations(sources: Column) -> Column:
    """The part of a prompt that names the sources to cite, where there are any."""
    return F.when(F.length(F.coalesce(sources, F.lit(""))) > 0, F.concat(F.lit("\nCite these sources as [number]:\n"), sources)).otherwise("")
