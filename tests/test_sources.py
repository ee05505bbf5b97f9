"""Images of zipped documents, the study data source, its stream state, its writer, and functions in SQL."""

import io
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from scholia.operators import chunking, images, markdown
from scholia.sources import datasource, functions, office, output
from scholia.streaming.incremental import StudyState, state_stream

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def png(w, h, fill=0):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + bytes([fill]) * w) * h)) + chunk(b"IEND", b"")


def rel(rid, target, kind="image", mode=""):
    return f'<Relationship Id="{rid}" Type="{R}/{kind}" Target="{target}" {mode}/>'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx():
    drawing = '<wp:inline><wp:docPr id="1" name="{}" {}/><a:graphic><pic:pic><a:blip r:embed="{}"/></pic:pic></a:graphic></wp:inline>'
    body = drawing.format("Picture 1", 'descr="A curve"', "rId1") + drawing.format("Picture 2", "", "rId2") + drawing.format("Again", 'descr="Later"', "rId1")
    xml = f'<w:document xmlns:w="w" xmlns:wp="{office._WP[1:-1]}" xmlns:a="{office._A[1:-1]}" xmlns:r="{R}" xmlns:pic="pic"><w:body>{body}</w:body></w:document>'
    rels = rel("rId1", "media/image1.png") + rel("rId2", "media/image2.png") + rel("rId3", "media/unused.png") + rel("rId4", "http://x/y.png", mode='TargetMode="External"') + rel("rId5", "styles.xml", "styles")
    return zipped(**{"word/document.xml": xml, "word/_rels/document.xml.rels": RELS.format(rels), "word/media/image1.png": png(200, 150), "word/media/image2.png": png(50, 300), "word/media/unused.png": png(120, 120)})


def pptx():
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="2" name="{}"/></p:nvPicPr><p:blipFill><a:blip r:embed="{}"/></p:blipFill></p:pic>'
    slide = lambda x: f'<p:sld xmlns:p="{office._P[1:-1]}" xmlns:a="{office._A[1:-1]}" xmlns:r="{R}">{x}</p:sld>'
    deck = f'<p:presentation xmlns:p="{office._P[1:-1]}" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="a"/><p:sldId r:id="b"/></p:sldIdLst></p:presentation>'
    return zipped(**{
        "ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": RELS.format(rel("b", "slides/slide1.xml", "slide") + rel("a", "slides/slide2.xml", "slide")),
        "ppt/slides/slide1.xml": slide(pic.format("Diagram", "rId2") + pic.format("Diagram copy", "rId2")), "ppt/slides/_rels/slide1.xml.rels": RELS.format(rel("rId2", "../media/a.png")),
        "ppt/slides/slide2.xml": slide(pic.format("First", "rId7")), "ppt/slides/_rels/slide2.xml.rels": RELS.format(rel("rId7", "/ppt/media/b.png")),
        "ppt/media/a.png": png(300, 200, 9), "ppt/media/b.png": png(200, 150)})


def test_images_of_zipped_documents(spark):
    files = spark.createDataFrame([("d", "docx", docx()), ("p", "pptx", pptx()), ("bad", "docx", b"no zip"), ("none", "pptx", None), ("t", "txt", b"text")], "id string, file_type string, content binary")
    found = office.office_images(files)
    rows = sorted(((r["source_document_id"], r["page_or_slide"], r["ord"], r["caption"], r["content"]) for r in found.collect()), key=str)
    assert [r[:4] for r in rows] == [("d", None, 0, "A curve"), ("d", None, 1, "Picture 2"), ("d", None, 2, None), ("p", 1, 0, "First"), ("p", 2, 0, "Diagram"), ("p", 2, 1, "Diagram copy")]
    assert rows[0][4] == rows[3][4] == png(200, 150)
    kept = {(r["width"], r["height"]): r["file_path"] for r in images.extracted_images(found).collect()}
    # The small one goes, equal bytes are one file.
    assert set(kept) == {(200, 150), (120, 120), (300, 200)} and len(set(kept.values())) == 3


def test_folder_as_a_source(spark, tmp_path):
    spark.dataSource.register(datasource.StudySource)
    read = lambda p: spark.read.format("study").load(str(p))
    with pytest.raises(Exception, match="FileNotFoundError"):
        read(tmp_path / "nowhere").count()
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (("b.md", b"# B"), ("deep/a.TXT", b"text \xff"), ("x.unknown", b"?"), ("noext", b"?")):
        (tmp_path / "in" / name).write_bytes(data)
    with pytest.raises(Exception, match="NotADirectoryError"):
        read(tmp_path / "in" / "b.md").count()
    rows = {os.path.relpath(r["path"], tmp_path / "in"): (r["size"], bytes(r["content"])) for r in read(tmp_path / "in").collect()}
    assert rows == {"b.md": (3, b"# B"), "deep/a.TXT": (6, b"text \xff")} and datasource.listed(str(tmp_path / "in"))[1] == 2
    assert spark.read.format("study").option("unknown", "true").load(f"file://{tmp_path}/in").count() == 4
    many = [(f"f{i}", 40 << 20, 0) for i in range(3)] + [(f"g{i}", 1, 0) for i in range(2500)]
    assert [len(p.files) for p in datasource._partitions(many)] == [1, 1, 1000, 1000, 501]


def test_files_are_written_by_tasks_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"assets/{i % 5}.bin", bytes([i % 5]) * 10) for i in range(40)] + [("a/b/c.md", "é".encode()), ("empty", None)], "path string, content binary").repartition(6)
    assert len(output.write(rows, str(tmp_path))) == 42
    found = {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs}
    assert found == {f"assets/{i}.bin" for i in range(5)} | {"a/b/c.md", "empty"}
    times = {p: os.stat(tmp_path / p).st_mtime_ns for p in found}
    output.write(rows, str(tmp_path))
    assert times == {p: os.stat(tmp_path / p).st_mtime_ns for p in found} and (tmp_path / "a/b/c.md").read_text() == "é"
    output.write(spark.createDataFrame([("a/b/c.md", "new")], "path string, content string"), str(tmp_path))
    assert (tmp_path / "a/b/c.md").read_text() == "new"
    with pytest.raises(Exception, match="leaves the folder"):
        output.write(spark.createDataFrame([("../out.md", "x")], "path string, content string"), str(tmp_path))


def test_the_stream_knows_its_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    state = StudyState(spark, str(tmp_path / "state"))

    def trigger():
        state_stream(spark, str(folder), state, str(tmp_path / "ck")).awaitTermination()
        return {os.path.basename(r["source_path"]): r["change"] for r in state.states().collect()}, sorted((os.path.basename(r["source_path"]), r["content"]) for r in state.chunks().collect())

    (folder / "a.md").write_text("alpha")
    (folder / "b.md").write_text("beta")
    (folder / "skip.bin").write_bytes(b"x")
    assert trigger() == ({"a.md": "new", "b.md": "new"}, [("a.md", "alpha"), ("b.md", "beta")])
    later = (folder / "b.md").stat().st_mtime_ns + 10**9
    for name, text in (("a.md", "alpha two"), ("b.md", "beta"), ("c.md", "gamma")):
        (folder / name).write_text(text)
        os.utime(folder / name, ns=(later, later))
    # A file that was only touched is read again, but not chunked again.
    want = {"a.md": "modified", "b.md": "unchanged", "c.md": "new"}, [("a.md", "alpha two"), ("b.md", "beta"), ("c.md", "gamma")]
    assert trigger() == want and trigger() == want
    log = spark.read.parquet(f"{tmp_path}/state/chunks")
    assert {os.path.basename(r["source_path"]): r["n"] for r in log.groupBy("source_path").agg(F.count("*").alias("n")).collect()} == {"a.md": 2, "b.md": 1, "c.md": 1}
    # A repeated epoch ends in the same state.
    spark.dataSource.register(datasource.StudySource)
    state.take(spark.read.format("study").load(str(folder)), 1)
    assert {os.path.basename(r["source_path"]): r["change"] for r in state.states().collect()} == want[0]


def test_functions_in_sql(spark, sf):
    assert set(functions.register(spark)) >= {"study_chunks", "study_tokens"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.createOrReplaceTempView("study_documents")
    got = spark.sql("SELECT CAST(d.doc_id AS STRING) AS document_id, c.position, c.content, c.n_tokens FROM study_documents d, LATERAL study_chunks(d.text) c")
    want = chunking.create_chunks(docs, "doc_id", "text").select("document_id", "position", "content", "n_tokens")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > docs.count() / 2
    md = "pre\n## One\na\n\n### Two  \nb\n# Top\nc\n## Three"
    one = spark.createDataFrame([(0, md)], "k int, md string")
    one.createOrReplaceTempView("study_md")
    rows = spark.sql("SELECT s.* FROM study_md, LATERAL study_sections(md) s ORDER BY section").collect()
    assert [tuple(r) for r in rows] == [(r["section"], r["title"], r["body"]) for r in markdown.sections(one, "k", "md").orderBy("section").collect()]
    r = spark.sql("SELECT study_tokens('12345678') a, study_strip('\\u00a0 x ') b, study_paragraphs('a\\n\\n\\n b \\n\\n') c, study_sentences('A b. C! ') d, study_keywords('The QUICK-brown brown') e, study_headings('# A\\nx\\n### B ') f").first()
    assert tuple(r) == (2, "x", ["a", "b"], ["A b.", "C!"], ["quick", "brown"], ["A", "B"])
