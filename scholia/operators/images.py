"""Images of documents: sizes from file headers, content-addressed names, captions, placement."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_WIDTH = MIN_HEIGHT = 100
VISION_CANDIDATES, MOST_IMAGES = 15, 3


def size_of(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) from a PNG, GIF, BMP or JPEG header; None for anything else."""
    data = bytes(data or b"")
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return "gif", *struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "bmp", w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + n
    except (struct.error, IndexError):
        pass
    return None


def _sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size_of(d) or (None, None, None) for d in data], columns=["format", "width", "height"])


def header(data: Column) -> Column:
    return F.pandas_udf(_sizes, "format string, width int, height int")(data)


def extracted_images(images: DataFrame, folder: str = "output/assets/images", least_width: int = MIN_WIDTH, least_height: int = MIN_HEIGHT) -> DataFrame:
    """Readable images (content) that are large enough on both sides, named by their digest,
    once for each file."""
    rows = images.withColumn("h", header(F.col("content"))).where((F.col("h.width") >= least_width) & (F.col("h.height") >= least_height))
    name = F.concat(F.lit(folder + "/"), F.substring(F.sha2("content", 256), 1, 16), F.lit("."), "h.format")
    rows = rows.select(*images.columns, name.alias("file_path"), "h.width", "h.height")
    first = F.row_number().over(W.partitionBy("file_path").orderBy("source_document_id"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def nearest_captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Captions of images (id, page, x, y) from the text blocks (page, block, bx, by, text) of their page.

    Blocks are seen in turn; one that is nearer than all before it gives the caption if it has text, and
    sets the distance to beat even if it has none.
    """
    turn = W.partitionBy("id").orderBy("block")
    near = images.join(blocks, "page").withColumns({"d": F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), "t": F.regexp_replace("text", r"(?U)^\s+|\s+$", "")})
    before = F.min("d").over(turn.rowsBetween(W.unboundedPreceding, -1))
    records = near.withColumn("before", before).where("before IS NULL OR d < before")
    return records.groupBy("id").agg(F.max_by(F.when(F.length("t") > 0, F.col("t")), F.when(F.length("t") > 0, F.col("block"))).alias("caption"))


def vision_candidates(images: DataFrame, topic: str, most: int = VISION_CANDIDATES) -> DataFrame:
    """Up to `most` images of each topic, described ones first."""
    rank = F.row_number().over(W.partitionBy(topic).orderBy(F.col("ai_description").isNull(), "ord"))
    return images.withColumn("rank", rank).where(F.col("rank") <= most)


def accepted(judged: DataFrame, topic: str, most: int = MOST_IMAGES) -> DataFrame:
    """The first `most` relevant ones of each topic."""
    rank = F.row_number().over(W.partitionBy(topic).orderBy("rank"))
    return judged.where("relevant").withColumn("place", rank).where(F.col("place") <= most)


def insert_images(lines: list[str], images: list[tuple[str, str]]) -> list[str]:
    """Image blocks (position, block) put after the introduction, after a named section, before
    the conclusion, or at the end; from the last to the first, so that places stay right."""
    def place(position: str) -> int:
        heads = [i for i, x in enumerate(lines) if x.startswith("## ")]
        wanted = position.lower()
        if "introduction" in wanted:
            return heads[0] if heads else len(lines)
        if "conclusion" in wanted:
            return next((i for i in heads if "conclusion" in lines[i].lower()), len(lines))
        if wanted.startswith("after section"):
            name = wanted.partition(":")[2].strip()
            for k, i in enumerate(heads):
                if name and name in lines[i].lower():
                    return heads[k + 1] if k + 1 < len(heads) else len(lines)
        return len(lines)

    out = list(lines)
    for at, _, block in sorted(((place(p), k, b) for k, (p, b) in enumerate(images)), reverse=True):
        out[at:at] = [block]
    return out
