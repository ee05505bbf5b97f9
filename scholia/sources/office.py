"""Images inside zipped documents, as relations: which part a relationship id names, which caption a
drawing with that id has, and the parts' bytes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Namespaces and relation types of the two formats.
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_IMAGE, _SLIDE = "/relationships/image", "/relationships/slide"


def _relations(zipped: zipfile.ZipFile, part: str, kind: str) -> dict[str, str]:
    """Relationship ids of a part with the parts inside the file that they name, in order."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in zipped.namelist():
        return {}
    found = (r for r in ElementTree.fromstring(zipped.read(path)).iter(_REL) if r.get("Type", "").endswith(kind) and r.get("TargetMode") != "External")
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in found}


def _slides(zipped: zipfile.ZipFile) -> list[str]:
    """Slide parts in the order of the presentation."""
    known = _relations(zipped, "ppt/presentation.xml", _SLIDE)
    if known:
        listed = ElementTree.fromstring(zipped.read("ppt/presentation.xml")).iter(f"{_P}sldId")
        return [known[s.get(f"{_R}id")] for s in listed if s.get(f"{_R}id") in known]
    return sorted((n for n in zipped.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def _docx(zipped: zipfile.ZipFile) -> Iterator[tuple]:
    """(kind, slide, place, rid, caption, bytes): parts are kind 0, drawings kind 1."""
    for i, (rid, target) in enumerate(_relations(zipped, "word/document.xml", _IMAGE).items()):
        if target in zipped.namelist():
            yield 0, None, i, rid, None, zipped.read(target)
    for i, drawing in enumerate(d for tag in ("inline", "anchor") for d in ElementTree.fromstring(zipped.read("word/document.xml")).iter(f"{_WP}{tag}")):
        about = next(drawing.iter(f"{_WP}docPr"), None)
        caption = None if about is None else about.get("descr") or about.get("name") or None
        for blip in drawing.iter(f"{_A}blip"):
            yield 1, None, i, blip.get(f"{_R}embed"), caption, None


def _pptx(zipped: zipfile.ZipFile) -> Iterator[tuple]:
    for slide, part in enumerate(_slides(zipped), 1):
        for i, (rid, target) in enumerate(_relations(zipped, part, _IMAGE).items()):
            if target in zipped.namelist():
                yield 0, slide, i, rid, None, zipped.read(target)
        for i, shape in enumerate(ElementTree.fromstring(zipped.read(part)).iter(f"{_P}pic")):
            name = next((n.get("name") or None for n in shape.iter(f"{_P}cNvPr")), None)
            for blip in shape.iter(f"{_A}blip"):
                yield 1, slide, i, blip.get(f"{_R}embed"), name, None


def office_parts(files: DataFrame) -> DataFrame:
    """Rows (id, kind, slide, place, rid, caption, content) of DOCX and PPTX files (id, file_type, content);
    a damaged file has the rows that were read before the damage."""
    schema = "id string, kind int, slide int, place int, rid string, caption string, content binary"
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    for row in (_docx if kind == "docx" else _pptx)(zipfile.ZipFile(io.BytesIO(data or b""))):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, *row), types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue

    return files.where(F.col("file_type").isin("docx", "pptx")).select("id", "file_type", "content").mapInArrow(read, schema)


def office_images(files: DataFrame) -> DataFrame:
    """Images (source_document_id, page_or_slide, ord, caption, content): in a DOCX each relationship
    once, with the alternative text or else the name of its first drawing; in a PPTX each picture of each slide,
    with its name.  Empty parts are left out; `images.extracted_images` measures and names them."""
    rows = office_parts(files)
    keys = ["id", "slide", "rid"]
    parts = rows.where("kind = 0 AND length(content) > 0").select(*keys, "place", "content")
    drawn = rows.where("kind = 1").select(*keys, F.col("place").alias("at"), "caption")
    first = F.row_number().over(W.partitionBy(*keys).orderBy("at"))
    # Without a slide the file is a DOCX: only its first drawing counts.
    drawn = drawn.withColumn("n", first).where("slide IS NOT NULL OR n = 1").drop("n")
    same = (parts["id"] == drawn["id"]) & parts["slide"].eqNullSafe(drawn["slide"]) & (parts["rid"] == drawn["rid"])
    joined = parts.join(drawn, same, "left").select(parts["id"], parts["slide"], "place", "at", "caption", "content")
    joined = joined.where("slide IS NULL OR at IS NOT NULL")
    return joined.select(
        F.col("id").alias("source_document_id"), F.col("slide").alias("page_or_slide"), F.coalesce(F.when(F.col("slide").isNotNull(), F.col("at")), F.col("place")).alias("ord"), "caption", "content")
