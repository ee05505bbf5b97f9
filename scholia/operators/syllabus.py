"""Syllabus structure and outlines.

A syllabus is an array of lines.  What a line is follows from its own form, from the next
line that is not blank (a numbered line with something deeper below is a chapter) and from
the chapters before it, so the grammar is projections over the arrays of a text's own lines;
any number of texts is read at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from . import outline

#: The words that open a chapter line, and the forms of chapter and section lines.
CHAPTER_WORDS = "Chapter|Capitolo|Module|Modulo|Unit|Uni[tà]|Topic|Tema|Section|Sezione|Lezione|Argomento|Parte|Part"
NAMED = rf"(?iU)^\*{{0,2}}(?:#{{1,3}}\s+)?(?:{CHAPTER_WORDS})\s+(?:\d+|[IVXLCDM]+)(?:\s*[:.\-]\s+|\s+)(.+?)\*{{0,2}}$"
NUMBERED = r"(?U)^\d+[.)]\s+(.+)$"
MARKED = r"(?U)^#{1,3}\s+(?:\d+|[IVXLCDM]+)[.)]\s+(.+?)\*{0,2}$"
NUMBERED_SECTION = r"(?U)^\d+(?:\.\d+)*[.)]?\s+\*?\*?(.+?)\*?\*?\s*$"
LETTERED_SECTION = r"(?U)^\(?[a-zA-Z]\)?\.?\s+\*?\*?(.+?)\*?\*?\s*$"
BULLET_SECTION = r"(?U)^[-•*]\s+\*?\*?(.+?)\*?\*?\s*$"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def text_lines(c: Column) -> Column:
    """The lines of a text; a line end at its end begins no other line."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _line_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, items), items the structs (pos, chapter, section) of a text's lines that are not blank."""
    rows = df.select(F.col(key).cast("string").alias("key"), text_lines(F.col(text)).alias("lines"))
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
    cut = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), T.strip(x).alias("bare"), indent(x).alias("indent")))
    rows = rows.select("key", F.size("lines").alias("n"), F.filter(cut, lambda x: F.length(x["bare"]) > 0).alias("cut"))
    # A form's group is never empty, so an empty extract is a line of another form.
    form = lambda x, pattern: T.strip(F.nullif(F.regexp_extract(x["bare"], pattern, 1), F.lit("")))

    def chapter(x, i):  # noqa: ANN001, ANN202
        deeper = F.coalesce(F.get("cut", i + 1)["indent"] > x["indent"], x["pos"] == F.col("n") - 2)
        return F.coalesce(form(x, NAMED), F.when(deeper, form(x, NUMBERED)), form(x, MARKED))

    def section(x):  # noqa: ANN001, ANN202
        lettered = form(x, LETTERED_SECTION)
        return F.coalesce(form(x, NUMBERED_SECTION), F.when(F.length(lettered) > 1, lettered), form(x, BULLET_SECTION))

    named = F.transform("cut", lambda x, i: F.struct(x["pos"].alias("pos"), x["bare"].alias("bare"), chapter(x, i).alias("chapter")))
    rows = rows.select("key", named.alias("named"))
    return rows.select("key", F.transform("named", lambda x: F.struct(
        x["pos"].alias("pos"), x["chapter"].alias("chapter"), F.when(x["chapter"].isNull(), section(x)).alias("section"))).alias("items"))


def syllabus_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """The lines of texts that are not blank, as rows (key, pos, chapter, section): the title of a
    chapter that begins there, or the section that the line is if it stands in a chapter.

    First form that fits: a named chapter, a numbered line with something deeper below, a
    numbered heading; then a numbered, lettered or bulleted section.  A numbered line counts as
    a chapter too if the text ends with one blank line after it.
    """
    return _line_forms(df, key, text).select("key", F.explode_outer("items").alias("x")).where("x IS NOT NULL").select("key", "x.pos", "x.chapter", "x.section")


def syllabus_structure(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, idx, title, sections): the chapters of texts in order, with their sections.

    Lines before a text's first chapter are left out; a text without one (a flat or empty
    syllabus) has no rows.  Each text is read where it is: nothing is shuffled.
    """
    items = F.col("items")
    starts = F.filter(F.transform(items, lambda x, i: F.when(x["chapter"].isNotNull(), i)), lambda i: i.isNotNull())
    rows = _line_forms(df, key, text).withColumn("starts", starts)

    def held(i, j):  # noqa: ANN001, ANN202
        own = F.slice(items, i + 2, F.coalesce(F.get("starts", j + 1), F.size(items)) - i - 1)
        return F.transform(F.filter(own, lambda x: x["section"].isNotNull()), lambda x: x["section"])

    chapters = F.transform("starts", lambda i, j: F.struct(F.get(items, i)["chapter"].alias("title"), held(i, j).alias("sections")))
    # An outer explode: for a plain one the optimiser puts a test of the array's size below all
    # projections, where each array would be computed again.
    return rows.select("key", F.posexplode_outer(chapters).alias("idx", "c")).where("idx IS NOT NULL").select("key", "idx", "c.title", "c.sections")


def entries(c: Column) -> Column:
    """Syllabus entries, one a line, without one bullet, number or Roman numeral in front; of three characters or more."""
    bare = F.transform(text_lines(c), lambda x: T.strip(F.regexp_replace(T.strip(x), r"(?U)^(?:[-•*]|\d+[.)]|[ivxIVX]+[.)])\s+", "")))
    return F.filter(bare, lambda x: F.length(x) > 2)


def unique_anchors(df: DataFrame, anchor: Column, order: str) -> DataFrame:
    """Anchors by input order; the k-th of equal ones gets the suffix -k."""
    n = F.row_number().over(W.partitionBy("_anchor").orderBy(order))
    df = df.withColumn("_anchor", anchor).withColumn("_n", n)
    return df.withColumn("anchor", F.when(F.col("_n") == 1, F.col("_anchor")).otherwise(F.concat_ws("-", "_anchor", F.col("_n").cast("string")))).drop("_anchor", "_n")


def index_entries(chapters: DataFrame) -> DataFrame:
    """Chapters (idx, title, sections) as index rows (title, anchor, level, ord); blank titles have none."""
    rows = chapters.select("idx", F.posexplode(F.concat(F.array("title"), "sections")).alias("pos", "title")).where(~T.is_blank(F.col("title")))
    rows = rows.withColumn("ord", (F.row_number().over(W.orderBy("idx", "pos")) - 1).cast("int"))
    rows = rows.withColumn("level", F.when(F.col("pos") == 0, 1).otherwise(2))
    return unique_anchors(rows, U.slug(F.col("title")), "ord").select("title", "anchor", "level", "ord")


def render_toc(df: DataFrame, *keys: str) -> DataFrame:
    """A nested list of links by key, from rows (title, anchor, level, ord)."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("ord"), line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("toc"))


def claim_topics(chapters: DataFrame, topics: DataFrame) -> DataFrame:
    """Each chapter (idx, title) in turn claims its best free topic (ord, name): rows (idx, ord).

    A manual's chapters and topics are short lists, so one group chooses; `outline` holds the score.
    """

    def claim(left: pa.Table, right: pa.Table) -> pa.Table:
        tp = sorted(right.to_pylist(), key=lambda r: r["ord"])
        names, taken, rows = [t["name"] or "" for t in tp], set(), []
        for c in sorted(left.to_pylist(), key=lambda r: r["idx"]):
            i = outline.best_topic(c["title"] or "", names, taken)
            if i is not None:
                taken.add(i)
                rows.append((c["idx"], tp[i]["ord"]))
        return pa.table([pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)], names=["idx", "ord"])

    one = F.lit(0).alias("manual")
    left = chapters.select(one, F.col("idx").cast("int").alias("idx"), "title").groupBy("manual")
    return left.cogroup(topics.select(one, F.col("ord").cast("int").alias("ord"), "name").groupBy("manual")).applyInArrow(claim, "idx int, ord int")
