"""Templates, sources, character budgets and the merge of chapters into one manual."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U

#: What stands before the first chapter outside the syllabus, and after cut material.
EXTRA_HEADING = "---\n\n## Additional Topics (not in syllabus)\n\n"
TRUNCATED = "\n...[truncated]"
#: Fixed value: characters of source material that a prompt holds at most.
MATERIAL_CAP = 131072


class TemplateError(Exception):
    """A template can't be used."""


class TemplateNotFoundError(TemplateError):
    pass


class TemplateRenderError(TemplateError):
    pass


def sources_block(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Numbered sources in the order in which chunks cite them, without syllabi."""
    first = chunks.groupBy("document_id").agg(F.min("ord").alias("first"))
    cited = first.join(documents.where(~F.col("is_syllabus")), first["document_id"] == documents["id"])
    rows = F.sort_array(F.collect_list(F.struct("first", "title", "source_path")))
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"], F.lit(" — `"), x["source_path"], F.lit("`"))
    return cited.agg(F.array_join(F.transform(rows, line), "\n").alias("sources"))


def budget_prefix(rows: DataFrame, group: list[str], order: str, length: Column, most: int) -> DataFrame:
    """The rows whose running length stays within a budget, and the part of the row at its edge."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_n", length).withColumn("running", F.sum("_n").over(w))
    before = F.col("running") - F.col("_n")
    left = most - before
    taken = F.when(F.col("running") <= most, F.col("_n")).when((before <= most) & (left > 200), left - 20).otherwise(0)
    return rows.withColumn("taken", taken).where((F.col("taken") > 0) & (before <= most)).drop("_n")


def material_limit(most: int, depth: int) -> int:
    """Characters of source material at a depth from 1 to 10: a third more for each step, up to the cap."""
    return min(int(most * (1.0 + (max(1, min(10, depth)) - 1) * 0.33)), MATERIAL_CAP)


def material_rows(chunks: DataFrame, topic: str, most: int = 150_000, depth: int = 5, least: int = 20) -> DataFrame:
    """Chunks (topic, ord, content) that enter a topic's prompt, as rows (topic, ord, part).

    Chunks of fewer than `least` characters are left out, but count for the numbers of the others.  A
    chunk counts with its head and its stripped text; the first that doesn't fit is cut where more than
    200 characters are left, and nothing follows it.
    """
    limit, w = material_limit(most, depth), W.partitionBy(topic).orderBy("ord")
    rows = chunks.withColumns({"body": T.strip(F.col("content")), "number": F.row_number().over(w)}).where(F.length("body") >= least)
    head = F.concat(F.lit("--- Source "), F.col("number").cast("string"), F.lit(" ---"))
    size = F.length(head) + F.length("body")
    rows = rows.withColumns({"head": head, "running": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)), "size": size})
    left = limit - (F.col("running") - F.col("size"))
    cut = F.concat(F.substring("body", F.lit(1), (left - 20).cast("int")), F.lit(TRUNCATED))
    body = F.when(F.col("running") <= limit, F.col("body")).when(left > 200, cut)
    return rows.where((left >= 0) & body.isNotNull()).select(topic, "ord", F.concat("head", F.lit("\n"), body).alias("part"))


def chunks_text(chunks: DataFrame, topic: str, most: int = 150_000, depth: int = 5, least: int = 20) -> DataFrame:
    """The prompt's source material of each topic (bounded by the limit of characters)."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "part")))
    return material_rows(chunks, topic, most, depth, least).groupBy(topic).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("material"))


def apply_template(template: str, columns: dict[str, Column]) -> Column:
    """A template's {{name}} places filled.  A table of contents behind quote marks keeps them on each
    line; without contents, that place goes as a whole.  Runs of blank lines become one."""
    for name in ("title", "content"):
        if "{{" + name + "}}" not in template:
            raise TemplateRenderError(f"the template has no place for {name}")
    value = lambda name: F.coalesce(columns.get(name, F.lit("")), F.lit(""))
    out = F.lit(template)
    for name in ("images", "sources", "content"):
        out = F.replace(out, F.lit("{{" + name + "}}"), value(name))
    toc = value("toc")
    if quoted := re.search(r"^(\s*>+\s*)\{\{toc\}\}\s*$", template, re.M):
        lines = F.array_join(F.transform(F.split(toc, "\n"), lambda x: F.concat(F.lit(quoted[1]), x)), "\n")
        out = F.replace(out, F.lit(quoted[0]), F.when(F.length(toc) > 0, lines).otherwise(""))
    else:
        out = F.replace(out, F.lit("{{toc}}"), toc)
    return F.regexp_replace(F.replace(out, F.lit("{{title}}"), value("title")), r"([^\n]+)\n\n+([^\n])", "$1\n\n$2")


def render_images(caption: Column, path: Column) -> Column:
    return F.concat(F.lit("!["), caption, F.lit("]("), path, F.lit(")\n*"), caption, F.lit("*\n"))


def broken_anchors(content: DataFrame, entries: DataFrame) -> DataFrame:
    """Index anchors without a heading of that slug (content: md; entries: anchor)."""
    found = content.select(F.explode(T.headings(F.col("md"))).alias("h")).select(U.slug(F.col("h")).alias("anchor")).distinct()
    return entries.join(found, "anchor", "left_anti")


def chapter_filename(number: Column, title: Column) -> Column:
    return F.concat(F.lit("cap_"), (number + 1).cast("string"), F.lit("_"), U.slug(title), F.lit(".md"))


def sort_by_syllabus(chapters: DataFrame, topics: DataFrame) -> DataFrame:
    """Chapters (ord, title) that name a syllabus topic by its position, then the rest in input order."""
    placed = topics.where("syllabus_position IS NOT NULL").groupBy(F.lower("name").alias("_k")).agg(F.min("syllabus_position").alias("position"))
    joined = chapters.join(placed, F.lower("title") == F.col("_k"), "left").drop("_k")
    rank = F.row_number().over(W.orderBy(F.col("position").isNull(), "position", "ord"))
    return joined.withColumn("place", rank)


def without_local_toc(md: Column) -> Column:
    """A chapter without the list of links that follows its title, blank lines among them, before its first section.

    Each line is one letter of a word (title, section, link, blank, other); the list is a part of that word.
    """
    rows = T.lines(md)
    kind = lambda x: F.when(F.rlike(x, F.lit(r"(?U)^#\s+")), "T").when(F.rlike(x, F.lit(r"(?U)^##\s+")), "S").when(
        F.rlike(T.strip(x), F.lit(r"(?U)^-\s+\[")), "L").when(F.length(T.strip(x)) == 0, "B").otherwise("O")
    word = F.array_join(F.transform(rows, kind), "")
    head = F.length(F.regexp_extract(word, "^[^TS]*T", 0))
    listed = F.length(F.regexp_extract(word, "^[^TS]*T((?:B*L)*)", 1))
    return F.when(listed > 0, F.array_join(F.concat(F.slice(rows, F.lit(1), head), F.slice(rows, head + listed + 1, F.size(rows))), "\n")).otherwise(md)


def numbered(md: Column, number: Column) -> Column:
    """The first title with its number in front."""
    return F.regexp_replace(md, F.lit(r"(?s)\A(.*?(?:^|\n))#\s+([^\n]+)"), F.concat(F.lit("$1# "), number.cast("string"), F.lit(". $2")))


def merge_chapters(chapters: DataFrame, topics: DataFrame, stamp: str, scope: str = "full", depth: int = 5) -> DataFrame:
    """One manual (md) from chapters (ord, md): ordered, cleaned, numbered, with contents in front."""
    titled = chapters.withColumn("title", T.title(F.col("md")))
    placed = sort_by_syllabus(titled, topics)
    # A manual's extra topics are one short list; a title that holds one, or is held by one, is extra.
    names = topics.where("extra_in_notes").agg(F.collect_set(F.lower(T.strip(F.col("name")))).alias("_e"))
    title = F.lower(T.strip(F.col("title")))
    placed = placed.join(F.broadcast(names)).withColumn("extra", F.exists("_e", lambda e: F.contains(e, title) | F.contains(title, e))).drop("_e")
    first_extra = F.row_number().over(W.partitionBy("extra").orderBy("place")) == 1
    body = numbered(T.image_paths(without_local_toc(F.col("md"))), F.col("place"))
    mark = F.when(F.col("extra") & F.col("first_extra"), F.lit(EXTRA_HEADING)).otherwise(F.lit(""))
    placed = placed.withColumn("first_extra", first_extra).withColumns({"body": F.concat(mark, body), "anchor": U.slug(F.concat(F.col("place").cast("string"), F.lit(" "), F.col("title")))})
    rows = F.sort_array(F.collect_list(F.struct("place", "title", "anchor", "body")))
    toc = F.array_join(F.transform(rows, lambda x: F.concat(F.lit("- ["), x["title"], F.lit("](#"), x["anchor"], F.lit(")"))), "\n")
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["body"], F.lit("\n\n---"))), "\n\n")
    head = F.format_string("<!-- generated %s | scope %s | chapters %d | depth %d -->\n\n# Exam manual\n\n", F.lit(stamp), F.lit(scope), F.count("*"), F.lit(depth))
    return placed.agg(F.concat(head, toc, F.lit("\n\n---\n\n"), text).alias("md"))
