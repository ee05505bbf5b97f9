"""The boundary to a text-generating model: prompts in, cached or provided responses out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import llm_json as J
from ..functions import text as T
from ..functions.batches import bound_batches
from ..plans.storage import Store
from ..sources import state


class GenerationError(Exception):
    """A provider failed."""


class ConnectionFailed(GenerationError):
    pass


class TimedOut(GenerationError):
    pass


class BadResponse(GenerationError):
    pass


Provider = Callable[[str, str], str]  # (model, prompt) -> response


def with_retries(provider: Provider, retries: int = 3, longest: float = 30.0) -> Provider:
    """Repeats after connection errors and timeouts, waiting 1, 2, 4 ... seconds."""
    def call(model: str, prompt: str) -> str:
        for k in range(retries):
            try:
                return provider(model, prompt)
            except (ConnectionFailed, TimedOut):
                if k == retries - 1:
                    raise
                time.sleep(min(2.0**k, longest))
        raise BadResponse("no attempt was allowed")
    return call


def generate(prompts: DataFrame, cache: DataFrame, provider: Provider, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(responses of all prompts, new cache rows).  Only distinct misses reach the provider."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = with_retries(provider)
        for batch in batches:
            answers = [call(m, p) for m, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.string())], names=["model", "prompt", "response"])

    asked = state.misses(prompts, cache).select("model", "prompt").distinct().mapInArrow(ask, "model string, prompt string, response string")
    # Written once: both results read the same answers, and no miss is asked twice.
    rows = state.to_cache(Store(prompts.sparkSession).save(asked, "answers"), stamp)
    known = cache.select("key", "response").unionByName(rows.select("key", "response"))
    return state.probe(prompts, known), rows


def topic_prompt(material: Column, syllabus: Column) -> Column:
    return F.concat(
        F.lit("Read the study material and list its topics as JSON {\"topics\": [{name, description, related_documents, chunk_ids, subtopic_count}]}.\n"),
        F.when(T.is_blank(syllabus), F.lit("")).otherwise(F.concat(F.lit("Follow this syllabus:\n"), syllabus, F.lit("\n"))),
        F.lit("Material:\n"), material)


def outline_prompt(topics: Column) -> Column:
    return F.concat(F.lit("Arrange these topics into chapters with sections as JSON {\"chapters\": [{title, sections}]}.\n"), topics)


def chapter_prompt(name: Column, description: Column, sections: Column, material: Column, depth: Column) -> Column:
    return F.concat(
        F.lit("Write a chapter in Markdown as JSON {title, content, sections}.\nTopic: "), name, F.lit("\n"), description,
        F.lit("\nSections: "), F.array_join(sections, "; "), F.lit("\nDetail (1 to 5): "), T.depth_band(depth).cast("string"), F.lit("\nMaterial:\n"), material)


def parse_topics(responses: DataFrame, *keys: str) -> DataFrame:
    """Topics (ord, name, ...) of responses, with defaults and without repeated names."""
    from .dedup import first_wins

    rows = responses.select(*keys, F.posexplode(J.parse_json(F.col("response"), J.TOPICS)["topics"]).alias("ord", "t"))
    name = F.when(T.is_invalid_name(F.col("t.name")), F.concat(F.lit("Topic "), (F.col("ord") + 1).cast("string"))).otherwise(T.strip(F.col("t.name")))
    none = F.array().cast("array<string>")
    topics = rows.select(
        *keys, "ord", name.alias("name"), F.coalesce("t.description", F.lit("")).alias("description"), F.coalesce("t.related_documents", none).alias("related_documents"),
        F.coalesce("t.chunk_ids", none).alias("chunk_ids"), F.greatest(F.lit(0), F.coalesce("t.subtopic_count", F.lit(0))).alias("subtopic_count"),
        F.col("t.syllabus_position").alias("syllabus_position"))
    return first_wins(topics, [*map(F.col, keys), F.lower(T.strip(F.col("name")))], "ord")


def judge_topics(answers: DataFrame) -> DataFrame:
    """Answers (key, response) with a list of topics are right, others can't be used."""
    found = J.parse_json(F.col("response"), J.TOPICS)["topics"].isNotNull()
    return answers.select("key", F.when(found, "ok").otherwise("unusable").alias("verdict"), F.lit(None).cast("string").alias("feedback"))


def _outlines(responses: pd.Series) -> pd.DataFrame:
    rows = []
    for text in responses:
        try:
            found = J.loads(text or "")
        except ValueError as e:
            rows.append((None, str(e)))
            continue
        fields = {k.lower(): v for k, v in found.items()} if isinstance(found, dict) else {}
        fields |= {"chapters": found["chapters"]} if isinstance(found, dict) and isinstance(found.get("chapters"), list) else {}
        if not isinstance(fields.get("chapters"), list):
            rows.append((None, f"the model reported an error: {found['error']}" if isinstance(found, dict) and "error" in found else "no list of chapters"))
            continue
        chapters = []
        for c in fields["chapters"]:
            title = str(c.get("title", "")).strip() if isinstance(c, dict) else ""
            given = c.get("sections") if isinstance(c, dict) and isinstance(c.get("sections"), list) else []
            sections = [s.strip() if isinstance(s, str) else str(s.get("title", "")).strip() for s in given if isinstance(s, (str, dict))]
            if title:
                chapters.append({"title": title, "sections": [s for s in sections if s]})
        rows.append((chapters, None))
    return pd.DataFrame(rows, columns=["chapters", "error"])


def read_outline(c: Column) -> Column:
    """A response as chapters, or the error that it is: the list under `chapters` in any case, sections as
    texts or as objects with a title; chapters without a title are left out."""
    return F.pandas_udf(_outlines, "chapters array<struct<title:string,sections:array<string>>>, error string")(c)


def parse_outline(responses: DataFrame, *keys: str) -> DataFrame:
    bound_batches(responses.sparkSession)
    rows = responses.withColumn("outline", read_outline(F.col("response")))
    # An outer explode: for a plain one the optimiser would read each response twice, once in a test of the list's size.
    return rows.select(*keys, F.posexplode_outer("outline.chapters").alias("idx", "c")).where("idx IS NOT NULL").select(*keys, "idx", "c.title", "c.sections")


def judge_outlines(topics: DataFrame):  # noqa: ANN201
    """A judge of outlines: every topic (key, ord, name, description, missing_from_notes) with notes must be covered."""
    from . import matching

    def judge(answers: DataFrame) -> DataFrame:
        read = answers.select("key", read_outline(F.col("response")).alias("o"))
        chapters = read.select("key", F.posexplode("o.chapters").alias("idx", "c")).select("key", "idx", "c.title", "c.sections")
        wanted = topics.where(~F.coalesce("missing_from_notes", F.lit(False)))
        lost = wanted.join(matching.chapter_topics(chapters, topics, "key").select("key", "ord").distinct(), ["key", "ord"], "left_anti")
        names = F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
        lost = lost.groupBy("key").agg(F.concat(F.lit("these topics are missing: "), F.array_join(names, ", ")).alias("feedback"))
        verdict = F.when(F.col("o.chapters").isNull(), "unusable").when(F.col("feedback").isNotNull(), "faulty").otherwise("ok")
        return read.join(lost, "key", "left").select("key", verdict.alias("verdict"), F.when(verdict == "faulty", F.col("feedback")).alias("feedback"))

    return judge
