import io
import zipfile

import re

import pytest
from pyspark.sql import functions as F

from scholia.operators import assemble, chunking, dedup, generation, images, markdown, matching, syllabus
from scholia.plans import study
from scholia.plans.storage import Store
from scholia.sources import files, state


def test_chunks_respect_limits():
    text = "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(15))
    chunks = chunking.chunk_text(text, 80, 10)
    assert len(chunks) > 1 and all(chunking.estimate(c) <= 100 for c in chunks)
    assert chunking.chunk_text(None) == [] and chunking.chunk_text("  \n\n ") == []
    assert "".join(chunking.chunk_text("x" * 50, 5)) == "x" * 50


def test_chunk_table(spark):
    df = spark.createDataFrame([("a", "one.\n\ntwo."), ("b", None)], "id string, t string")
    rows = chunking.create_chunks(df, "id", "t").collect()
    assert [(r["document_id"], r["content"], r["position"]) for r in rows] == [("a", "one.\n\ntwo.", 0)]


def test_exact_and_near_dedup(spark):
    base = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(0, base, "/a"), (1, base, "/a/longer"), (2, base + "!", "/c"), (3, "Nothing in common at all here", "/d")]
    df = spark.createDataFrame(rows, "ord int, content string, path string")
    exact = dedup.dedup_exact(df, "content", "path", "ord")
    assert sorted(r["ord"] for r in exact.collect()) == [1, 2, 3]
    kept = dedup.deduplicate(df, "content", "path", "ord", Store(spark), 0.90)
    assert sorted(r["ord"] for r in kept.collect()) == [2, 3]


def test_tiers_prefer_ids(spark):
    chunks = spark.createDataFrame([("c1", "d1", "Vector spaces"), ("c2", "d2", "Derivatives")], "id string, document_id string, content string")
    topics = spark.createDataFrame(
        [(0, "Vector", ["c2"], []), (1, "Other", [], ["d1"]), (2, "Derivatives rule", [], ["none"])],
        "ord int, name string, chunk_ids array<string>, related_documents array<string>")
    got = {(r["ord"], r["id"], r["tier"]) for r in matching.chunks_for_topics(topics, chunks).collect()}
    assert got == {(0, "c2", 1), (1, "c1", 2), (2, "c2", 3)}


def test_syllabus_coverage(spark):
    entries = spark.createDataFrame([(0, "Linear Algebra"), (1, "Probability"), (2, "Statistics")], "idx int, title string")
    topics = spark.createDataFrame([(0, "Linear algebra", ["d1"]), (1, "Quantum Physics", ["d1"])], "ord int, name string, related_documents array<string>")
    chunks = spark.createDataFrame([("c", "d1", "vectors")], "id string, document_id string, content string")
    rows = matching.covered_syllabus(topics, entries, chunks).orderBy("extra_in_notes", "syllabus_position").collect()
    assert [(r["syllabus_position"], r["missing_from_notes"], r["extra_in_notes"]) for r in rows] == [
        (0, False, False), (1, True, False), (2, True, False), (None, False, True)]


def structure(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    out = [[] for _ in texts]
    for r in syllabus.syllabus_structure(df, "k", "t").orderBy("key", "idx").collect():
        assert r["idx"] == len(out[int(r["key"])])
        out[int(r["key"])].append((r["title"], r["sections"]))
    return out


def test_syllabus_grammar(spark):
    mixed = "Intro\n### 1. First\n- a\n- b\n### 2. Second\n- c\nChapter III: Third\n1. x\n   a) deep item"
    forms = ("Module 2\nChapter 1: Intro\n1.1 One\n(a) Three\n2 Two words\nModule 2\n\n**capitolo iv - Bold one**\n- **bold**\n1. Flat\n- same depth\n"
             "2. Deep\n   plain\n\n\n 3) Gap\n\n\t\t\ta. x\n\t\t\ta. yy\n### II. **Marked**\n### ii. not marked\n• dot\n+ plus")
    many = "\n".join(f"### {i + 1}. Part {i}\n" + "\n".join(f"- item {i}.{j}" for j in range(n)) for i, n in enumerate((2, 10, 12, 5)))
    got = structure(spark, mixed, forms, many, "1. only", None, "", "1. one\n2. two\n3. three", "1. one\r\n  a\r\n2. two\n\n", "1. last\n\n\n", "Unit 1 A - b\x0b- c")
    assert got[0] == [("First", ["a", "b"]), ("Second", ["c"]), ("Third", []), ("x", ["deep item"])]
    assert got[1] == [("Intro", ["One", "Three", "Two words"]), ("Bold one", ["bold", "Flat", "same depth"]), ("Deep", []), ("Gap", ["yy"]), ("**Marked", ["dot"])]
    assert [(t, len(x)) for t, x in got[2]] == [(f"Part {i}", n) for i, n in enumerate((2, 10, 12, 5))]
    assert got[3:7] == [[], [], [], []]
    assert got[7] == [("one", []), ("two", [])] and got[8] == [] and got[9] == [("A", ["b", "c"])]


def test_anchors_and_claims(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x")], "ord int, a string")
    assert [r["anchor"] for r in syllabus.unique_anchors(df, F.col("a"), "ord").orderBy("ord").collect()] == ["x", "x-2", "x-3"]
    chapters = spark.createDataFrame([(0, "Linear Algebra"), (1, "Linear Algebra")], "idx int, title string")
    topics = spark.createDataFrame([(0, "linear algebra"), (1, "Advanced linear algebra")], "ord int, name string")
    assert sorted(map(tuple, syllabus.claim_topics(chapters, topics).collect())) == [(0, 0), (1, 1)]


MANUAL = "# M\n\n- [A](#a)\n- [B](#b)\n\n## A\n\nFirst thing here. Second thing.\n\n## B\n\nThird thing is this. Fourth.\n"


def test_manual_checks(spark):
    def status(md, **more):
        df = spark.createDataFrame([("m", md)], "manual string, md string")
        return {r["check"]: r["status"] for r in markdown.validate(df, **more).collect()}

    good = status(MANUAL)
    assert good["markdown_structure"] == good["empty_chapters"] == good["missing_sections"] == good["duplicate_content"] == good["toc_structure"] == "pass"
    assert status(MANUAL.replace("#b)", "#nope)"))["toc_structure"] == "fail"
    assert status(MANUAL + "```\n")["markdown_structure"] == "fail"
    assert status(MANUAL + "## C\n\n## D\n\nText here.\n")["empty_chapters"] == "fail"
    assert status("# M\n\n## A\n\nSame body here. Yes.\n\n## B\n\nSame body here. Yes.\n")["duplicate_content"] == "fail"
    meta = spark.createDataFrame([("a", 0, 1), ("b", 1, 0)], "title string, ord int, syllabus_position int")
    assert status(MANUAL, meta=meta)["syllabus_order"] == "fail"
    known = spark.createDataFrame([("x.png",)], "file_path string")
    assert status(MANUAL + "![a](y.png)\n", images=known)["image_references"] == "fail"


def test_template(spark):
    df = spark.createDataFrame([("T", "Body", "- [a](#a)\n- [b](#b)")], "title string, content string, toc string")
    cols = {c: F.col(c) for c in ("title", "content", "toc")}
    assert df.select(assemble.apply_template("# {{title}}\n\n> {{toc}}\n\n{{content}}\n", cols)).first()[0] == "# T\n\n> - [a](#a)\n\n> - [b](#b)\nBody\n"
    empty = cols | {"toc": F.lit("")}
    assert df.select(assemble.apply_template("# {{title}}\n> {{toc}}\n{{content}}", empty)).first()[0] == "# T\n\nBody"
    call = "# {{title}}\n\n> [!recap] R\n>\n> {{toc}}\n\n{{content}}"
    assert df.select(assemble.apply_template(call, cols)).first()[0] == "# T\n\n> [!recap] R\n>\n> - [a](#a)\n> - [b](#b)\nBody"
    assert df.select(assemble.apply_template(">> {{toc}}\n{{title}} {{content}}", cols)).first()[0] == ">> - [a](#a)\n>> - [b](#b)\nT Body"
    with pytest.raises(assemble.TemplateRenderError):
        assemble.apply_template("# {{title}} without the other", cols)


def test_sources_and_merge(spark):
    chunks = spark.createDataFrame([(0, "doc-b"), (1, "doc-a"), (2, "doc-a")], "ord int, document_id string")
    docs = spark.createDataFrame([("doc-a", "Notes A", "/data/a.md", False), ("doc-b", "Notes B", "/data/b.md", False)], "id string, title string, source_path string, is_syllabus boolean")
    assert assemble.sources_block(chunks, docs).first()[0] == "1. Notes B — `/data/b.md`\n2. Notes A — `/data/a.md`"
    chapters = spark.createDataFrame([(0, "# Calculus\n\nb"), (1, "# Algebra\n\na")], "ord int, md string")
    topics = spark.createDataFrame([("Algebra", 0, False), ("Calculus", 1, False)], "name string, syllabus_position int, extra_in_notes boolean")
    md = assemble.merge_chapters(chapters, topics, "2024-01-01").first()["md"]
    assert md.index("# 1. Algebra") < md.index("# 2. Calculus") and "](#1-algebra)" in md


def test_state_and_cache(spark):
    schema = "source_path string, content_hash string, created_at int, updated_at int"
    old, new = spark.createDataFrame([("p", "h1", 1, 1)], schema), spark.createDataFrame([("p", "h2", 5, 5), ("q", "h3", 6, 6)], schema)
    rows = {r["source_path"]: (r["content_hash"], r["created_at"]) for r in state.upsert(old, new, "source_path").collect()}
    assert rows == {"p": ("h2", 1), "q": ("h3", 6)}
    prompts = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "model string, prompt string")
    cache = spark.createDataFrame([], "key string, prompt_preview string, response string, model string, created_at timestamp")
    answered, rows = generation.generate(prompts, cache, lambda m, p: f"{m}:{p}", "2024-01-01 00:00:00")
    assert sorted(r["response"] for r in answered.collect()) == ["m:a", "m:b", "n:a"]
    assert state.misses(prompts, rows).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "syllabus.txt").write_bytes(b"ok \xff")
    (tmp_path / "x.bin").write_bytes(b"1")
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(doc.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.scan_directory(spark, str(tmp_path))
    assert [(r["title"], r["file_type"], r["is_syllabus"]) for r in found.collect()] == [("a", "docx", False), ("bad", "docx", False), ("syllabus", "txt", True)]
    texts = {r["title"]: (r["text"], r["error"]) for r in files.parse_files(found).join(found.select("id", "title"), "id").collect()}
    assert texts == {"a": ("Hello\n\na | b", None), "bad": ("", "BadZipFile"), "syllabus": ("ok �", None)}
    before = found.select("source_path", "content_hash", F.lit(1).alias("updated_at"))
    assert {r["change"] for r in files.classify(found, before).collect()} == {"unchanged"}
    assert {r["change"] for r in files.classify(found, before.limit(0)).collect()} == {"new"}


def test_phases(spark):
    docs = spark.createDataFrame(
        [("d1", "/n.md", "Vectors and   spaces.\n\nMore text.", False, 0), ("d2", "/m.md", "Vectors and spaces.\n\nMore text.", False, 1), ("s", "/syllabus.md", "### 1. Vectors\n- spaces", True, 2)],
        "id string, source_path string, content string, is_syllabus boolean, ord int")
    store = Store(spark)
    prepared = study.prepare(docs, store)
    assert prepared["documents"].count() == 1 and prepared["chunks"].count() == 1
    topics = spark.createDataFrame([(0, "Vectors", ["d1"])], "ord int, name string, related_documents array<string>")
    outlined = study.outline_phase(prepared, topics, store)
    assert [r["anchor"] for r in outlined["index"].orderBy("ord").collect()] == ["vectors", "spaces"]
    bodies = spark.createDataFrame([(0, "# Vectors\n\n## spaces\n\nA vector. Another. Third.\n")], "ord int, md string")
    manual, checks = study.chapters_phase(outlined, bodies, "2024-01-01")
    assert "# 1. Vectors" in manual.first()["md"] and checks.first()["n_checks"] == 6


def in_turn(names, entries, words, least, strict):
    """What a pass over the entries ends with, by plain loops."""
    out = {}
    for o, name in names:
        a, best, score = name.lower().strip(), None, 0.0
        for i, entry in entries:
            b = entry.lower().strip()
            if a == b:
                best, score = i, 2.0
                break
            held = min(len(a), len(b)) / max(len(a), len(b), 1) if a in b or b in a else 0.0
            x, y = words(a), words(b)
            shared = len(x & y) / max(len(x), len(y), 1)
            if held > score or shared > score:
                best, score = i, held if held > score else shared
        if best is not None and (score > least if strict else score >= least):
            out[o] = (best, score)
    return out


def test_entries_are_seen_in_turn(spark):
    names = list(enumerate(["sde ito", "PDE", "Bayes", "x", "stochastic calculus of ito", "linear algebra", "none of these", "", "é b", "ito calculus sde"]))
    titles = ["sde ito fundamentals", "ito sde calculus", "Bayes rule", "the x", "pde", "algebra, linear", "algebra linear and more", "linear", "b", "calculus", "é b c", "PDE", "Stochastic"]
    entries = list(enumerate(titles))
    tp, en = spark.createDataFrame(names, "ord int, name string"), spark.createDataFrame(entries, "idx int, title string")
    split = lambda t: {w for w in re.split(r"[^a-z0-9]+", t) if len(w) >= 2}
    got = {r["ord"]: (r["idx"], r["score"]) for r in matching.match_entries(tp, en).collect()}
    assert got == in_turn(names, entries, split, 0.2, False) and got[0] == (1, 2 / 3)
    for focus in ("ito calculus", "Linear", "zzz", "é"):
        got = [(r["idx"], r["score"]) for r in matching.closest_topic(focus, en.select(F.col("idx").alias("ord"), F.col("title").alias("name"))).collect()]
        assert got == list(in_turn([(0, focus)], entries, lambda t: set(t.split()), 0.0, True).values())


def test_words_of_a_long_segment_overlap():
    got = chunking.chunk_text(" ".join(f"w{i:05d}" for i in range(3000)))
    starts = [c.split()[0] for c in got]
    assert starts[0] == "w00000" and all(len(c.split()) <= 1024 for c in got) and len(got) > 1
    for a, b in zip(got, got[1:]):
        tail = [w for w in a.split() if w in set(b.split())]
        assert 0 < len(tail) and sum(max(1, len(w + " ") // 4) for w in tail) <= 64 and b.split()[: len(tail)] == tail == a.split()[-len(tail) :]
    assert chunking.chunk_text("aa " * 9, 4, 0)[0] == "aa aa aa aa" and chunking.chunk_text("aa " * 9, 4, 100)[1] == "aa aa aa"


def test_material_within_a_budget(spark):
    body = [(0, "x" * 10), (1, " " + "a" * 300 + " "), (2, "b" * 400), (3, "c" * 50)]
    df = spark.createDataFrame([("t", o, c) for o, c in body], "topic string, ord int, content string")
    got = lambda most, depth=1: (assemble.chunks_text(df, "topic", most, depth).first() or [None, None])[1]
    full = ["--- Source 2 ---\n" + "a" * 300, "--- Source 3 ---\n" + "b" * 400, "--- Source 4 ---\n" + "c" * 50]
    assert got(10_000) == "\n\n".join(full) and got(316) == full[0] and got(315) == "--- Source 2 ---\n" + "a" * 295 + "\n...[truncated]"
    assert got(316 + 200) == full[0] and got(316 + 201) == full[0] + "\n\n--- Source 3 ---\n" + "b" * 181 + "\n...[truncated]"
    assert got(400, 2) == got(532) and got(200) is None and assemble.material_limit(150_000, 10) == 131072


def test_nearer_blocks_give_the_caption(spark):
    found = spark.createDataFrame([("i", 1, 0.0, 0.0), ("j", 2, 0.0, 0.0)], "id string, page int, x double, y double")
    blocks = spark.createDataFrame([(1, 0, 5.0, 0.0, " far "), (1, 1, 1.0, 0.0, "  "), (1, 2, 3.0, 0.0, "behind"), (2, 0, 9.0, 0.0, "")], "page int, block int, bx double, by double, text string")
    assert {r["id"]: r["caption"] for r in images.nearest_captions(found, blocks).collect()} == {"i": "far", "j": None}


def test_topics_of_chunks_are_found_once_in_few_rows(spark):
    from scholia.operators import matching

    topics = spark.createDataFrame([(i, "Shared words") for i in range(-70, 200)] + [(500, "it"), (501, "other thing")], "ord int, name string")
    chunks = spark.createDataFrame([("a", "a", "the Words are shared, it is"), ("b", "b", "nothing"), ("c", "c", None)], "id string, document_id string, content string")
    found = matching.chunks_by_keyword(topics, chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((ord#\d+L?, id#|id#\d+, ord#|t#)", plan)
    want = {(i, "a") for i in range(-70, 200)} | {(500, "a"), (501, "b")}
    got = [(r["ord"], r["id"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want and found.schema["ord"].dataType.typeName() == "integer"
