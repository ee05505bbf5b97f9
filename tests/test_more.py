import struct

import pytest
from pyspark.sql import functions as F

from scholia.config import Config, ConfigValidationError
from scholia.operators import headings, images
from scholia.streaming.incremental import chunk_stream, file_stream


def test_headings(spark):
    md = "# Old\n\n## Introduzione ai vettori\n\n## Spazi\n\n## 💡 Tip\n"
    got = headings.align(md, "New", ["Introduzione vettori", "Spazio duale"])
    assert got == "# New\n\n## Introduzione vettori\n\n## Spazio duale\n\n## 💡 Tip\n"
    assert headings.align("# A\n\n## Zebra\n", "A", ["Quantum"]) == "# A\n\n## Zebra\n"
    assert headings.missing_sections("# A\n\n## 1. Béta\n", ["Beta", "Gamma"]) == ["Gamma"]
    df = spark.createDataFrame([(md, "New", ["Introduzione vettori", "Spazio duale"]), (None, None, None)], "md string, t string, s array<string>")
    assert [r[0] for r in df.select(headings.align_headings(F.col("md"), F.col("t"), F.col("s"))).collect()] == [got, None]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 200, 150)
    small = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 200, 50)
    df = spark.createDataFrame([("d1", png), ("d2", png), ("d3", small), ("d4", b"bad")], "source_document_id string, content binary")
    rows = images.extracted_images(df).collect()
    assert [(r["source_document_id"], r["width"], r["height"]) for r in rows] == [("d1", 200, 150)]
    found = spark.createDataFrame([("i", 1, 0.0, 0.0)], "id string, page int, x double, y double")
    blocks = spark.createDataFrame([(1, 0, 1.0, 1.0, "near"), (1, 1, 5.0, 5.0, "far"), (2, 0, 0.0, 0.0, "other")], "page int, block int, bx double, by double, text string")
    assert images.nearest_captions(found, blocks).first()["caption"] == "near"
    text = ["# T", "intro", "## A", "a", "## Conclusion", "c"]
    assert images.insert_images(text, [("after introduction", "I"), ("before conclusion", "J"), ("nowhere", "K")]) == ["# T", "intro", "I", "## A", "a", "J", "## Conclusion", "c", "K"]


def test_config():
    c = Config({"generation": {"depth_level": 99}})
    assert c.get("generation.depth_level") == 10 and c.get("llm.retries") == 3 and c.get("no.such", 1) == 1
    c.set("images.per_chapter", 5)
    assert c.get("images.per_chapter") == 5
    with pytest.raises(ConfigValidationError):
        Config({"generation": {"scope": "topic"}})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one.\n\ntwo.")
    for _ in range(2):
        chunk_stream(file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["one.\n\ntwo."]


def test_overlaps_read_each_text_once(spark):
    """Copies are compared as one class, pairs are those of brute force, and the result's plan reads written sets."""
    import re

    from scholia.operators import markdown

    said = lambda *ids: " ".join(f"Sentence {i} stands here." for i in ids)
    texts = [said(*range(10))] * 6 + [said(*range(9), 20 + i) for i in range(4)] + [said(*range(7), 30, 31, 32), said(1), said(40), "no sentence", None] + [said(1, 1, 1)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    sets = [set(re.findall(r"[A-Z][^.!?]*[.!?]", t or "")) for t in texts]
    want = {}
    for b in range(len(sets)):
        for a in range(b):
            if (least := min(len(sets[a]), len(sets[b]))) and (n := len(sets[a] & sets[b])) / least >= 0.8:
                want[a, b] = (n, n / least)
    found = markdown.sentence_overlaps(df, "id", "body")
    rows = found.collect()
    assert {(r["a"], r["b"]): (r["n_shared"], r["share"]) for r in rows} == want and len(rows) == len(want) > 40
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
