"""What a run leaves for its user: inventory, topics, outline, chapters, index, manual, checks.

Each output is a table (path, content) of a manual's few texts, rendered by expressions; `write`
puts them where the path says, through Spark's file systems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unicode as U

#: What heads the list of chapters.
INDEX_HEAD = ("# Indice del Manuale", "", "Capitoli generati sono contrassegnati con [X].", "")


def _file(content: Column, path: str) -> list[Column]:
    return [F.lit(path).alias("path"), content.alias("content")]


def _listed(order: str, *fields: Column | str) -> Column:
    """Structs of the fields in order, as one array."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("x"))))
    return F.transform(rows, lambda r: r["x"])


def inventory(documents: DataFrame, path: str = "output/inventory.json") -> DataFrame:
    """Documents (ord, id, title, source_path, file_type, is_syllabus) and the first syllabus among them."""
    found = F.min_by(F.when(F.col("is_syllabus"), F.col("id")), F.when(F.col("is_syllabus"), F.col("ord")))
    body = F.struct(
        F.coalesce(F.bool_or("is_syllabus"), F.lit(False)).alias("syllabus_detected"), found.alias("syllabus_document_id"),
        _listed("ord", "id", "title", "source_path", "file_type").alias("documents"))
    return documents.agg(F.to_json(body, {"ignoreNullFields": "false"}).alias("j")).select(*_file(F.col("j"), path))


def topics_file(topics: DataFrame, path: str = "output/topics.json") -> DataFrame:
    fields = ("name", "description", "related_documents", "order_source", "syllabus_position", "subtopic_count", "missing_from_notes", "extra_in_notes")
    rows = F.transform(_listed("ord", *fields), lambda x, i: x.withField("order", i))
    return topics.agg(F.to_json(F.struct(rows.alias("topics")), {"ignoreNullFields": "false"}).alias("j")).select(*_file(F.col("j"), path))


def outline_file(entries: DataFrame, path: str = "output/outline.md") -> DataFrame:
    """Index rows (ord, title, anchor, level) as a nested list of links, each with its line end."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")\n"))
    text = F.array_join(F.transform(_listed("ord", line.alias("l")), lambda x: x["l"]), "")
    return entries.agg(text.alias("t")).select(*_file(F.col("t"), path))


def chapter_files(chapters: DataFrame, folder: str = "output/chapters") -> DataFrame:
    """Chapters (idx from 0, title, md) as one file each."""
    name = F.concat(F.lit(f"{folder}/cap_"), (F.col("idx") + 1).cast("string"), F.lit("_"), U.slug(F.col("title")), F.lit(".md"))
    return chapters.select(name.alias("path"), F.col("md").alias("content"))


def existing_chapters(files: DataFrame, total: int) -> DataFrame:
    """Chapters (idx from 0) that files (path) of an earlier run hold."""
    number = F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), r"^cap_\s*\+?(\d{1,9})\s*(?:_.*)?\.md$", 1)
    found = files.select(F.when(F.length(number) > 0, number.cast("int")).alias("n"))
    return found.where(F.col("n").between(1, total)).select((F.col("n") - 1).alias("idx")).distinct()


def to_generate(chapters: DataFrame, existing: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """Chapters (idx) that are asked for and not there yet."""
    asked = chapters if selected is None else chapters.where(F.col("idx").isin(selected))
    return asked.join(existing, "idx", "left_anti")


def index_file(chapters: DataFrame, existing: DataFrame, path: str = "output/indice.md") -> DataFrame:
    """Chapters (idx, title, sections) as a list with a mark at those that exist."""
    marked = chapters.join(existing.select("idx", F.lit(True).alias("there")), "idx", "left")
    head = F.concat(F.when(F.col("there"), "- [X] ").otherwise("- [ ] "), (F.col("idx") + 1).cast("string"), F.lit(". "), F.col("title"))
    lines = F.concat(F.array(head), F.transform("sections", lambda s: F.concat(F.lit("    - "), s)))
    body = F.flatten(F.transform(_listed("idx", lines.alias("l")), lambda x: x["l"]))
    text = F.array_join(F.concat(F.array(*map(F.lit, INDEX_HEAD)), body, F.array(F.lit(""))), "\n")
    return marked.agg(text.alias("t")).select(*_file(F.col("t"), path))


def manual_file(manual: DataFrame, path: str = "output/manual.md") -> DataFrame:
    return manual.select(*_file(F.col("md"), path))


def validation_file(checks: DataFrame, path: str = "output/validation.json") -> DataFrame:
    """Checks (ord, check, status, errors) with the overall status and a summary."""
    n = lambda s: F.count_if(F.col("status") == s)
    body = F.struct(
        F.when(n("fail") > 0, "fail").when(n("warning") > 0, "warning").otherwise("pass").alias("overall"),
        _listed("ord", "check", "status", "errors").alias("checks"),
        F.struct(F.count("*").alias("total_checks"), n("pass").alias("passed"), n("warning").alias("warnings"), n("fail").alias("failed")).alias("summary"))
    return checks.agg(F.to_json(body).alias("j")).select(*_file(F.col("j"), path))


def scan_counters(files: DataFrame) -> DataFrame:
    """Counts of a scan (file_type, change)."""
    n = lambda c: F.count_if(F.col("change") == c)
    return files.agg(
        F.count("*").alias("n_found"), F.count_if(F.col("file_type") == "unknown").alias("n_skipped"),
        n("new").alias("n_new"), n("modified").alias("n_modified"), n("unchanged").alias("n_unchanged"))


def write(files: DataFrame, folder: str = "/") -> list[str]:
    """Writes rows (path, content) below a folder from the tasks that hold them, and returns the paths."""
    from .datasource import StudySource

    files.sparkSession.dataSource.register(StudySource)
    rows = files.select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    rows.write.format("study").mode("append").save(folder)
    return [r["path"] for r in files.select("path").collect()]


def read_template(spark, path: str) -> str:  # noqa: ANN001
    """The text of a template file; a missing or empty one is an error."""
    from pyspark.errors import AnalysisException

    from ..operators.assemble import TemplateNotFoundError, TemplateRenderError

    try:
        found = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        raise TemplateNotFoundError(path) from e
    if found is None or not found[0].strip():
        raise TemplateRenderError(f"{path} is empty")
    return found[0]


def probe_syllabus(files: DataFrame, folder: str) -> DataFrame:
    """The first syllabus by name right in a folder, from rows (path, file_type, is_syllabus)."""
    name = F.substring("path", len(folder.rstrip("/")) + 2, 1 << 30)
    own = F.startswith("path", F.lit(folder.rstrip("/") + "/")) & ~F.contains(name, F.lit("/"))
    usable = files.where(own & F.col("is_syllabus") & ~F.col("file_type").isin("unknown", "image"))
    return usable.agg(F.min(name).alias("name")).where("name IS NOT NULL")


def with_explicit_syllabus(documents: DataFrame, syllabus: DataFrame) -> DataFrame:
    """Documents and a syllabus file that was named, unless its type can't be read or it is blank."""
    usable = syllabus.where(~F.col("file_type").isin("unknown", "image") & (F.length(F.trim("content")) > 0))
    return documents.unionByName(usable.withColumn("is_syllabus", F.lit(True)).select(*documents.columns))
