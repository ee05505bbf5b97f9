"""Folders of study material as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def scan_directory(spark: SparkSession, path: str, syllabus_path: str | None = None) -> DataFrame:
    """Files below a folder, by path: id, title, source_path, file_type, is_syllabus, content (bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = T.file_type(F.col("path"))
    return files.select(
        T.stable_id(F.col("path")).alias("id"), T.file_stem(F.col("path")).alias("title"), F.col("path").alias("source_path"),
        kind.alias("file_type"), T.is_syllabus(F.col("path"), syllabus_path).alias("is_syllabus"), "content", T.sha256(F.col("content")).alias("content_hash"),
    ).where("file_type <> 'unknown'").orderBy("source_path")


def classify(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Files with change: new, modified or unchanged against the last state of their path."""
    last = state.groupBy("source_path").agg(F.max_by("content_hash", "updated_at").alias("previous_hash"))
    joined = files.join(last, "source_path", "left")
    if force:
        return joined.withColumn("change", F.lit("new"))
    return joined.withColumn("change", F.when(F.col("previous_hash").isNull(), "new").when(F.col("previous_hash") == F.col("content_hash"), "unchanged").otherwise("modified"))


def read_text(files: DataFrame) -> DataFrame:
    """Text of plain files; invalid bytes become the replacement character."""
    return files.where(F.col("file_type").isin("txt", "markdown")).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in body order; a row's cells are joined by a bar."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out: list[str] = []
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            out.append(words(node))
        elif node.tag == f"{_W}tbl":
            out.append("\n".join(" | ".join(words(c) for c in r.iter(f"{_W}tc")) for r in node.iter(f"{_W}tr")))
    return "\n\n".join(x for x in out if x)


def pptx_text(data: bytes) -> str:
    """Slides with number and title, body and notes."""
    deck = zipfile.ZipFile(io.BytesIO(data))
    number = lambda name: int(re.search(r"(\d+)\.xml$", name)[1])
    out = []
    for name in sorted((n for n in deck.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        title, body = "", []
        for shape in ElementTree.fromstring(deck.read(name)).iter(f"{_P}sp"):
            text = "\n".join(t for p in shape.iter(f"{_A}p") if (t := "".join(r.text or "" for r in p.iter(f"{_A}t")).strip()))
            kind = next((h.get("type") or "" for h in shape.iter(f"{_P}ph")), "")
            if kind in ("title", "ctrTitle") and not title:
                title = text
            elif text:
                body.append(text)
        notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
        extra = ""
        if notes in deck.namelist():
            extra = " ".join(t.text or "" for t in ElementTree.fromstring(deck.read(notes)).iter(f"{_A}t")).strip()
        parts = [f"## Slide {number(name)}: {title}".rstrip(": "), *body, *([f"[Notes]: {extra}"] if extra else [])]
        out.append("\n".join(parts))
    return "\n\n".join(out)


def pdf_text(data: bytes) -> str:
    """Pages' text; without a PDF library the row's error says so."""
    from pypdf import PdfReader

    return "\n\n".join(t for p in PdfReader(io.BytesIO(data)).pages if (t := (p.extract_text() or "").strip()))


PARSERS = {"docx": docx_text, "pptx": pptx_text, "pdf": pdf_text, "txt": lambda b: b.decode(errors="replace"), "markdown": lambda b: b.decode(errors="replace")}


def parse_files(files: DataFrame) -> DataFrame:
    """Rows (id, text, error): damaged files give an empty text and the error's name."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    out.append((name, PARSERS[kind](data or b"") if kind in PARSERS else "", None))
                except Exception as e:  # noqa: BLE001  a damaged file is a row with an error, whatever its reader raised
                    out.append((name, "", type(e).__name__))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["id", "text", "error"])

    return files.select("id", "file_type", "content").mapInArrow(parse, "id string, text string, error string")
