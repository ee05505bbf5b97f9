"""Outlines: which topics a chapter holds, topics outside of all chapters, and an outline's checks.

Choosing is exclusive and in turn, over the two short lists of one manual; manuals are
independent groups, so any number of them runs in parallel.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from . import matching

#: Words that do not count when a chapter chooses its topic.
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of by with from as is are was were be been being have has had do does did will would "
    "can could shall should may might this that these those it its they them their we our you your he she him her his not no "
    "nor all each every some any both few more most other into over such than then just about also very chapter".split()
)
LEAST_SCORE, LEAST_WORDS = 0.3, 2


def long_words(text: str) -> set[str]:
    return {w for w in re.split(r"[^a-z0-9]+", text.lower()) if len(w) >= 3}


def score(title: str, name: str) -> float:
    """2 for equal names; else the better of containment and of two or more common content words."""
    a, b = title.lower().strip(), name.lower().strip()
    if a == b:
        return 2.0
    within = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
    x, y = long_words(a) - STOP_WORDS, long_words(b) - STOP_WORDS
    common = len(x & y)
    return max(within, common / max(len(x), len(y)) if common >= LEAST_WORDS else 0.0)


def best_topic(title: str, names: list[str], taken: set[int]) -> int | None:
    """The free topic with the highest score, the earliest among equals."""
    free = [i for i in range(len(names)) if i not in taken]
    best = max(free, key=lambda i: score(title, names[i]), default=None)
    return best if best is not None and score(title, names[best]) >= LEAST_SCORE else None


def assign(chapters: list[tuple[str, list[str]]], names: list[str]) -> list[tuple[str, list[int]]]:
    """Title and topics of each chapter: its own topic first, whose name it takes, then its
    sections' topics, then topics that no chapter chose."""
    taken: set[int] = set()
    out: list[tuple[str, list[int]]] = []
    for title, sections in chapters:
        own = best_topic(title, names, taken)
        chosen = [] if own is None else [own]
        for section in sections:
            i = best_topic(section, names, taken.union(chosen))
            if i is not None:
                chosen.append(i)
        taken.update(chosen)
        out.append((title if own is None else names[own], chosen))
    places = {s.lower().strip(): k for k, (_, sections) in reversed(list(enumerate(chapters))) for s in sections if s.strip()}
    for i, name in enumerate(names):
        if i not in taken and out:
            x = long_words(name)
            shared = [len(x & y) / max(len(x), len(y), 1) for y in (long_words(t) for t, _ in out)]
            out[places.get(name.lower().strip(), shared.index(max(shared)))][1].append(i)
    return out


def chapters_with_topics(chapters: DataFrame, topics: DataFrame, key: str = "manual") -> DataFrame:
    """Chapters (key, idx, title, sections) with the topics (key, ord, name) that they hold, as
    rows (key, idx, title, sections, topic_ords).  Without chapters, each topic is a chapter."""
    schema = f"{key} string, idx int, title string, sections array<string>, topic_ords array<long>"

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        ch = sorted(left.to_pylist(), key=lambda r: r["idx"])
        tp = sorted(right.to_pylist(), key=lambda r: r["ord"])
        names = [t["name"] or "" for t in tp]
        if ch:
            found = assign([(c["title"] or "", c["sections"] or []) for c in ch], names)
            rows = [(c[key], c["idx"], title, c["sections"] or [], [tp[i]["ord"] for i in own]) for c, (title, own) in zip(ch, found, strict=True)]
        else:
            rows = [(t[key], k, names[k], [], [t["ord"]]) for k, t in enumerate(tp)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "idx", "title", "sections", "topic_ords"])

    left = chapters.select(F.col(key).cast("string").alias(key), F.col("idx").cast("int").alias("idx"), "title", "sections")
    right = topics.select(F.col(key).cast("string").alias(key), F.col("ord").cast("long").alias("ord"), "name")
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(place, schema)


def uncovered(topics: DataFrame, outline: DataFrame) -> DataFrame:
    """Topics (ord) that no chapter (topic_ords) holds; they become chapters of their own."""
    return topics.join(outline.select(F.explode("topic_ords").alias("ord")).distinct(), "ord", "left_anti")


def closest_topics(chapters: DataFrame, topics: DataFrame) -> DataFrame:
    """For chapters (idx, title) the free topic (ord, name) with most common words over three letters."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) > 3))
    left = chapters.select("idx", F.explode(words(F.col("title"))).alias("w"))
    common = left.join(topics.select("ord", F.explode(words(F.col("name"))).alias("w")), "w").groupBy("idx", "ord").agg(F.count("*").alias("n"))
    best = common.groupBy("idx").agg(F.max(F.struct("n", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select("idx", (-F.col("b.o")).alias("ord"), F.col("b.n").alias("common"))


def outline_warnings(chapters: DataFrame, topics: DataFrame, has_syllabus: bool = True) -> DataFrame:
    """Rows (kind, ord, name): topics with notes that no chapter covers or, where all are covered
    and a syllabus sets the order, the first topic whose first chapter comes before the last one's."""
    first = matching.chapter_topics(chapters, topics).groupBy("ord").agg(F.min("idx").alias("idx"))
    lost = topics.where(~F.coalesce("missing_from_notes", F.lit(False))).join(first, "ord", "left_anti")
    missing = lost.select(F.lit("missing").alias("kind"), "ord", "name")
    if not has_syllabus:
        return missing
    placed = topics.join(first, "ord").withColumn("before", F.lag("idx").over(W.orderBy("ord"))).where("idx < before")
    early = placed.agg(F.min_by(F.struct("ord", "name"), "ord").alias("t")).where("t IS NOT NULL").select(F.lit("order").alias("kind"), "t.ord", "t.name")
    some = lost.agg(F.count("*").alias("n"))
    return missing.unionByName(early.join(F.broadcast(some)).where("n = 0").drop("n"))


def topic_order(topics: DataFrame) -> DataFrame:
    """Topics with `place`: by syllabus position, those without one behind, extras last."""
    extra, position = F.coalesce("extra_in_notes", F.lit(False)), F.coalesce("syllabus_position", F.lit(999))
    return topics.withColumn("place", F.row_number().over(W.orderBy(extra, position, "ord")) - 1)


def format_topics(topics: DataFrame, *keys: str) -> DataFrame:
    """Topics (ord, name, description, subtopic_count) as a numbered block of text."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "name", "description", "subtopic_count")))

    def block(x, i):  # noqa: ANN001, ANN202
        described = F.when(F.length(x["description"]) > 0, F.concat(F.lit("\n   Description: "), x["description"])).otherwise("")
        counted = F.when(x["subtopic_count"] > 0, F.concat(F.lit("\n   Subtopics: "), x["subtopic_count"].cast("string"))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), x["name"], described, counted)

    return topics.groupBy(*keys).agg(F.array_join(F.transform(rows, block), "\n").alias("topics"))


def chunk_ids_by_name(answers: DataFrame) -> DataFrame:
    """Chunk ids by topic name, from rows (ord, name, chunk_ids): the last row of a name counts, empty lists don't."""
    named = answers.where((F.length("name") > 0) & (F.size("chunk_ids") > 0))
    return named.groupBy("name").agg(F.max_by("chunk_ids", "ord").alias("chunk_ids"))


def focus_topic(name: str, relevant: DataFrame) -> DataFrame:
    """The one topic of a focused manual, with as many subtopics as chunks are relevant."""
    return relevant.agg(F.lit(0).alias("ord"), F.lit(name).alias("name"), F.count("*").alias("subtopic_count"))


def coverage(topics: DataFrame) -> DataFrame:
    """Whether there are syllabus topics and extras, and how many topics lack notes."""
    return topics.agg(
        F.coalesce(F.bool_or(F.col("syllabus_position").isNotNull()), F.lit(False)).alias("has_syllabus"),
        F.coalesce(F.bool_or("extra_in_notes"), F.lit(False)).alias("has_extras"), F.count_if("missing_from_notes").alias("n_missing"))


def selected_chapters(answer: str | None, total: int) -> list[int] | None:
    """"1,3,5" as places from 0; what is no number of a chapter is left out; nothing means all."""
    if not (answer or "").strip():
        return None
    numbers = {int(p) for p in map(str.strip, answer.split(",")) if p.isdigit()}
    return sorted(n - 1 for n in numbers if 1 <= n <= total)


def violations(rows: DataFrame, required: list[str], least: dict[str, int]) -> DataFrame:
    """Rows that break their record's constraints, with the names of the fields in `errors`."""
    tests = [F.when(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) == 0, F.lit(f"{c} is required")) for c in required]
    tests += [F.when(F.col(c) < n, F.lit(f"{c} must be >= {n}")) for c, n in least.items()]
    return rows.withColumn("errors", F.array_compact(F.array(*tests))).where(F.size("errors") > 0)


def normalized_documents(raws: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(clean documents with counts, quarantined rows): a row without id or text is set aside."""
    bad = F.col("id").isNull() | F.col(text).isNull()
    clean = raws.where(~bad).withColumn(text, U.normalize_text(F.col(text)))
    counted = clean.withColumns({"char_count": F.length(text).cast("long"), "word_count": T.n_words(F.col(text)), "line_count": T.n_lines(F.col(text))})
    return counted, raws.where(bad)
