"""From documents to a manual: in two phases, or in one run of steps that resumes by fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import assemble, chunking, dedup, generation, markdown, matching, outline, syllabus
from ..operators import chapters as chapters_op
from .attempts import Ask, fixpoint
from .storage import Run, Store, fingerprint


def prepare(documents: DataFrame, store: Store, max_tokens: int = chunking.MAX_TOKENS, near: float | None = None) -> dict[str, DataFrame]:
    """Clean, unique documents and their chunks.

    documents: id, source_path, content, is_syllabus, ord.  Syllabi are not study material.
    """
    clean = documents.withColumn("content", U.normalize_text(F.col("content"))).where(~T.is_blank(F.col("content")))
    notes = clean.where(~F.coalesce("is_syllabus", F.lit(False)))
    unique = dedup.dedup_exact(notes, "content", "source_path", "ord").select(*notes.columns)
    if near is not None:
        unique = dedup.dedup_near(unique, "content", "source_path", "ord", store, near)
    unique = store.save(unique, "unique")
    return {
        "documents": unique, "syllabus": clean.where("is_syllabus"),
        "chunks": store.save(chunking.create_chunks(unique, "id", "content", max_tokens), "chunks"),
    }


def outline_phase(prepared: dict[str, DataFrame], topics: DataFrame, store: Store) -> dict[str, DataFrame]:
    """Topics in syllabus order, the outline's chapters with their topics and its index, written as tables."""
    structure = syllabus.syllabus_structure(first_syllabus(prepared["syllabus"]), "manual", "content").withColumnRenamed("key", "manual")
    structure = store.save(structure, "structure")
    entries = structure.select("idx", "title")
    covered = store.save(ordered_topics(matching.covered_syllabus(topics, entries, prepared["chunks"]), topics), "topics")
    chapters = store.save(syllabus_chapters(structure, covered), "chapters")
    return prepared | {"topics": covered, "chapters": chapters, "index": store.save(syllabus.index_entries(chapters), "index")}


def first_syllabus(documents: DataFrame) -> DataFrame:
    """The text of the first syllabus (manual, content)."""
    return documents.groupBy(F.lit("manual").alias("manual")).agg(F.min_by("content", "ord").alias("content"))


def ordered_topics(covered: DataFrame, given: DataFrame) -> DataFrame:
    """Covered topics by their place in the manual (`ord`), with what was given for their names."""
    placed = outline.topic_order(covered).withColumn("ord", F.col("place").cast("long")).drop("place")
    none = F.array().cast("array<string>")
    known = given.select("name", *(F.col(c) if c in given.columns else d.alias(c) for c, d in (("description", F.lit("")), ("chunk_ids", none))))
    known = known.groupBy("name").agg(F.first("description").alias("description"), F.first("chunk_ids").alias("chunk_ids"))
    return placed.join(known, "name", "left").withColumns({"description": F.coalesce("description", F.lit("")), "chunk_ids": F.coalesce("chunk_ids", none)})


def syllabus_chapters(structure: DataFrame, topics: DataFrame) -> DataFrame:
    """Chapters (idx, title, sections, topic_ords) by the syllabus; a flat one gives a chapter for each topic."""
    manual = F.lit("manual").alias("manual")
    return outline.chapters_with_topics(structure.select(manual, "idx", "title", "sections"), topics.select(manual, "ord", "name")).drop("manual")


def model_chapters(topics: DataFrame, ask: Ask, model: str, store: Store) -> DataFrame:
    """Chapters by a model that groups the topics, asked again with what its outline lacks."""
    key = F.lit("manual").alias("key")
    n = topics.count()
    block = outline.format_topics(topics.withColumn("key", key), "key")
    asks = block.select("key", F.lit(model).alias("model"), generation.outline_prompt(F.col("topics")).alias("prompt"), F.lit(max(16384, 256 * n)).alias("tokens"))
    judge = generation.judge_outlines(topics.withColumn("key", key))
    got = store.save(fixpoint(asks, judge, ask, store, "outline")[0], "outline_answers")
    if got.first()["response"] is None:
        raise generation.BadResponse("no usable outline")
    chapters = generation.parse_outline(got)
    held = matching.chapter_topics(chapters, topics).groupBy("idx").agg(F.sort_array(F.collect_set(F.col("ord").cast("long"))).alias("topic_ords"))
    return chapters.join(held, "idx", "left").withColumn("topic_ords", F.coalesce("topic_ords", F.array().cast("array<long>")))


def find_topics(prepared: dict[str, DataFrame], ask: Ask, model: str, store: Store, focus: str | None = None) -> DataFrame:
    """Topics of the material, asked again with more tokens while the answer can't be read; then covered
    against the syllabus, or reduced to the one nearest to a focus."""
    key = F.lit("manual").alias("key")
    plan = first_syllabus(prepared["syllabus"]).select("manual", F.col("content").alias("plan"))
    numbered = prepared["chunks"].withColumn("ord", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("document_id", "position")) - 1).withColumn("manual", F.lit("manual"))
    material = assemble.chunks_text(numbered, "manual").join(plan, "manual", "left")
    asks = material.select(key, F.lit(model).alias("model"), generation.topic_prompt(F.col("material"), F.coalesce("plan", F.lit(""))).alias("prompt"), F.lit(32768).alias("tokens"))
    got = store.save(fixpoint(asks, generation.judge_topics, ask, store, "topics")[0], "topics_answers")
    row = got.first()
    if row is None or row["response"] is None:
        raise generation.BadResponse("no usable list of topics")
    topics = store.save(generation.parse_topics(got), "parsed_topics")
    if focus is not None:
        near = matching.closest_topic(focus, topics).first()
        if near is None:
            raise TopicNotFoundError(focus)
        one = topics.where(F.col("ord") == near["idx"])
        relevant = matching.chunks_by_keyword(one.select("ord", F.lit(focus).alias("name")), prepared["chunks"]).count()
        if not relevant:
            raise TopicNotFoundError(f"nothing about {focus}")
        topics = one.withColumns({"subtopic_count": F.lit(relevant), "missing_from_notes": F.lit(False), "extra_in_notes": F.lit(False)})
        return topics.withColumn("ord", F.lit(0).cast("long")).withColumn("syllabus_position", F.lit(None).cast("int"))
    entries = plan.select(F.posexplode(syllabus.entries(F.col("plan"))).alias("idx", "title"))
    if entries.isEmpty():
        rows = topics.withColumns({"ord": F.col("ord").cast("long"), "missing_from_notes": F.lit(False), "extra_in_notes": F.lit(False)})
        return rows
    structure = syllabus.syllabus_structure(plan, "manual", "plan").select("idx", "title")
    entries = structure if not structure.isEmpty() else entries
    return ordered_topics(matching.covered_syllabus(topics, entries, prepared["chunks"]), topics)


class TopicNotFoundError(generation.GenerationError):
    """No topic or no material fits a focus."""


def write_chapters(chapters: DataFrame, topics: DataFrame, prepared: dict[str, DataFrame], ask: Ask, model: str, depth: int) -> DataFrame:
    """Chapters (ord, title, md, error) with the material of their topics; topics without notes get a
    placeholder, and topics that no chapter holds a chapter of their own behind the others."""
    lone = outline.uncovered(topics, chapters).select(
        (F.lit(1 << 20) + F.col("ord")).cast("long").alias("ord"), F.col("name").alias("title"), F.array().cast("array<string>").alias("sections"), F.array("ord").alias("topic_ords"))
    planned = chapters.select(F.col("idx").cast("long").alias("ord"), "title", "sections", "topic_ords").unionByName(lone)
    held = planned.select(F.col("ord").alias("chapter"), F.explode("topic_ords").alias("ord")).join(topics.select("ord", "name", "description", "missing_from_notes", "extra_in_notes"), "ord")
    about = held.groupBy("chapter").agg(
        F.min_by("description", "ord").alias("description"), F.bool_and(F.coalesce("missing_from_notes", F.lit(False))).alias("missing"),
        F.bool_and(F.coalesce("extra_in_notes", F.lit(False))).alias("extra"))
    found = matching.chunks_for_topics(topics, prepared["chunks"]).select("ord", "id").join(held.select("ord", "chapter"), "ord").select("chapter", "id").distinct()
    pieces = found.join(prepared["chunks"], "id").groupBy("chapter", "content").agg(F.min(F.struct("document_id", "position")).alias("at"))
    numbered = pieces.withColumn("ord", F.row_number().over(W.partitionBy("chapter").orderBy("at")) - 1)
    material = assemble.chunks_text(numbered, "chapter", depth=depth)
    rows = planned.join(about, planned["ord"] == about["chapter"], "left").drop("chapter").join(material.withColumnRenamed("chapter", "ord"), "ord", "left")
    described = F.coalesce("description", F.lit(""))
    asked = rows.where(~F.coalesce("missing", F.lit(False))).select(
        "ord", generation.chapter_prompt(F.col("title"), described, F.col("sections"), F.coalesce("material", F.lit("")), F.lit(depth)).alias("prompt"), F.lit(depth).alias("depth"), "title", "sections")
    written = chapters_op.generate_chapters(asked, lambda prompt, tokens: ask(model, prompt, tokens)).join(rows.select("ord", "extra"), "ord")
    body = chapters_op.with_banner(F.col("content"), F.col("extra"))
    md = F.when(F.startswith(body, F.lit("# ")), body).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), body))
    lost = rows.where("missing").select("ord", "title", F.concat(F.lit("# "), "title", F.lit("\n\n"), chapters_op.placeholder(F.col("title"), described)).alias("md"), F.lit(None).cast("string").alias("error"))
    return written.select("ord", "title", md.alias("md"), "error").unionByName(lost)


def manual(documents: DataFrame, run: Run, ask: Ask, model: str, stamp: str, depth: int = 5, focus: str | None = None, near: float | None = None) -> dict[str, DataFrame]:
    """From documents (id, source_path, content, is_syllabus, ord) to a checked manual, step by step.

    Every step is read from the run's folder if nothing that it is made from has changed: new documents
    with the same topics run no outline step, and an outline with the same material no chapter.
    """
    store, base = Store(run.spark), fingerprint(documents.select("id", "content", "is_syllabus", "ord"))
    made: dict[str, DataFrame] = {}

    def prepared() -> dict[str, DataFrame]:
        if not made:
            made.update(prepare(documents, store, near=near))
        return made

    chunks, mark = run.step("chunks", [base, str(near)], lambda: prepared()["chunks"])
    clean, mark_plan = run.step("syllabus", [base], lambda: prepared()["syllabus"])
    at_hand = {"chunks": chunks, "syllabus": clean}
    topics, mark_topics = run.step("topics", [mark, mark_plan, model, str(focus)], lambda: find_topics(at_hand, ask, model, store, focus))

    def outlined() -> DataFrame:
        if topics.where("syllabus_position IS NOT NULL").isEmpty():
            return syllabus_chapters(run.spark.createDataFrame([], "idx int, title string, sections array<string>"), topics) if focus else model_chapters(topics, ask, model, store)
        return syllabus_chapters(syllabus.syllabus_structure(first_syllabus(clean), "manual", "content"), topics)

    planned, mark_outline = run.step("outline", [mark_topics, mark_plan, model], outlined)
    written, mark_chapters = run.step("chapters", [mark_outline, mark_topics, mark, model, str(depth)], lambda: write_chapters(planned, topics, at_hand, ask, model, depth))
    bodies = written.where("md IS NOT NULL").select(F.col("ord").cast("int").alias("ord"), "md")
    merged, mark_manual = run.step("manual", [mark_chapters, mark_topics, stamp], lambda: assemble.merge_chapters(
        bodies, topics, stamp, "topic" if focus else "full", depth).select(F.lit("manual").alias("manual"), "md"))
    checks, _ = run.step("checks", [mark_manual, str(focus)], lambda: markdown.validate(merged, focus=focus))
    return {"chunks": chunks, "topics": topics, "outline": planned, "index": syllabus.index_entries(planned), "chapters": written, "manual": merged, "checks": checks}


def chapters_phase(state: dict[str, DataFrame], bodies: DataFrame, stamp: str, selected: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The manual and its checks from chapter texts (ord, md), all or the selected ones."""
    if selected is not None:
        bodies = bodies.where(F.col("ord").isin(selected))
    manual = assemble.merge_chapters(bodies, state["topics"], stamp).select(F.lit("manual").alias("manual"), "md")
    return manual, markdown.rollup(markdown.validate(manual))


def flagship(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Normalise, keep one of each content, chunk: chunks and tokens by document."""
    rows = documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_path"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))
    clean = rows.withColumn("content", T.normalize_lines(F.col("content"))).where(F.length("content") > 0)
    # Written once: choosing one of each content reads it twice.
    clean = Store(spark).save(clean, "clean")
    unique = dedup.dedup_exact(clean, "content", "source_path", "ord")
    chunks = chunking.create_chunks(unique, "id", "content")
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
