"""Outlines, chapters, outputs and the rules whose values are fixed, on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from scholia.functions import llm_json
from scholia.functions import text as T
from scholia.operators import assemble, chapters, generation, headings, markdown, outline, syllabus
from scholia.sources import output, state


def test_pdf_structure_anywhere_in_a_line(spark):
    given = "text endobj text\nkeep the stream here\nstream\n12 34 word\n12 34 two words\nWidth 5\n/Width 5 x\nsee the TRAILER now\nend"
    df = spark.createDataFrame([(given,), ("plain\n\n\n\ntext",)], "t string")
    got = [r[0] for r in df.select(T.normalize_lines(F.col("t"))).collect()]
    assert got == ["keep the stream here\n12 34 two words\nWidth 5\nend", "plain\n\ntext"]
    bad = spark.createDataFrame([("a Trailer, an ENDOBJ and 1 0 obj",), ("mainstream endstreams objects",), ("stream xref",)], "t string")
    assert [r[0] for r in bad.select(T.is_pdf_garbage(F.col("t"))).collect()] == [True, False, False]


def test_escaped_backslashes_stay_whole(spark):
    given = r'{"a": "\\sum \q \n \" \\"}'
    df = spark.createDataFrame([(given,)], "t string").select(llm_json.sanitize(F.col("t")).alias("t"))
    assert json.loads(df.first()[0]) == json.loads(r'{"a": "\\sum q \n \" \\"}') == llm_json.loads(given)


def test_align_headings():
    md = "# Something\n## Real Title\n## Teorema di Bayes\n## Definition of risk\n## 📝 Notes\nbody"
    sections = ["Bayes teorema", "Definizione di rischio"]
    got = headings.align(md, "Real title", sections).split("\n")
    # The repeated title is no section; what shares no word follows in order.
    assert got == ["# Real title", "## Real Title", "## Bayes teorema", "## Definizione di rischio", "## 📝 Notes", "body"]
    assert headings.align("no heading", "T", ["a"]) == "no heading"
    unlike = "# T\n## Zebra\n## Quiz\n## Xylophone"
    assert headings.align(unlike, "T", ["Bayes", "Risk", "Loss"]) == unlike
    assert headings.align("# T\n## Summary statistics", "T", ["Summary of statistics"]) == "# T\n## Summary of statistics"
    assert headings.missing_sections("# T\n## 1. Bàyes rule", ["Bayes Rule", "Loss"]) == ["Loss"]


def test_chapters_claim_topics_without_stop_words(spark):
    names = ["The use of the loss", "Bayes rule", "Loss functions in detail", "Extra topic", "Bayes networks"]
    assert outline.best_topic("The theory of the mind", names, set()) is None
    assert outline.best_topic("bayes rule", names, set()) == 1
    assert outline.best_topic("bayes rule", names, {1}) is None
    got = outline.assign([("Bayes rule and networks", ["Loss functions"]), ("Other", ["Extra topic", "x"])], names)
    assert got == [("Bayes rule", [1, 2, 0, 4]), ("Other", [3])]
    one = spark.createDataFrame([("m", 0, "A", ["b"])], "manual string, idx int, title string, sections array<string>")
    topics = spark.createDataFrame([("m", 5, "A"), ("m", 6, "zz"), ("n", 1, "alone")], "manual string, ord long, name string")
    rows = {(r["manual"], r["idx"]): (r["title"], r["topic_ords"]) for r in outline.chapters_with_topics(one, topics).collect()}
    assert rows == {("m", 0): ("A", [5, 6]), ("n", 0): ("alone", [1])}


def test_focus_is_a_share_of_keywords(spark):
    long = "word " * 500 + "bayesian inference"
    df = spark.createDataFrame([("m", long)], "manual string, md string")
    status = lambda focus, others=(): markdown.check_focus(df, focus, list(others)).first()["status"]
    assert status("Bayesian inference") == "pass" and status("Quantum fields") == "warning"
    assert status("Bayesian inference", ["inference rules", "BAYESIAN INFERENCE"]) == "warning"
    assert markdown.focus_keys("On the Bayes-rule of A") == ["bayes", "rule"]


def test_extra_chapters_by_containment(spark):
    ch = spark.createDataFrame([(0, "# Algebra\n\nb"), (1, "# Graph theory basics\n\na")], "ord int, md string")
    tp = spark.createDataFrame([("Algebra", 0, False), ("Graph Theory", None, True)], "name string, syllabus_position int, extra_in_notes boolean")
    md = assemble.merge_chapters(ch, tp, "2024-01-01").first()["md"]
    assert md.index("Algebra\n\nb") < md.index("Additional Topics (not in syllabus)") < md.index("# 2. Graph theory basics")


def test_chapter_attempts():
    good = json.dumps({"title": "T", "content": "# T\n## A\nx\ny\nz", "sections": ["A"]})
    asked = []

    def ask(answers):
        it = iter(answers)

        def call(prompt, tokens):
            asked.append((prompt, tokens))
            a = next(it)
            if isinstance(a, Exception):
                raise a
            return a
        return call

    ch, n = chapters.write_chapter(ask(["no json", generation.TimedOut("slow"), good.replace("## A", "## Zed"), good]), "p", 1000, "T", ["A"])
    assert n == 4 and ch["content"].startswith("# T\n## A")
    assert [t for _, t in asked] == [1000, 1500, 1500, 1500] and "missing: A" in asked[3][0] and "slow" in asked[2][0]
    with pytest.raises(chapters.ChapterError):
        chapters.write_chapter(ask([good.replace("x\\ny\\nz", "")] * 5), "p", 1000, None, None)


def test_generated_chapters(spark):
    rows = spark.createDataFrame([(0, "p", 3, "T", ["A"]), (1, "q", 30, None, None)], "ord long, prompt string, depth int, title string, sections array<string>")

    def ask(prompt, tokens):
        return json.dumps({"title": f"got {tokens}", "content": "# x\n## A\n[Chunk 3]\na\nb\nc"}) if prompt.startswith("q") or "T" in prompt or prompt == "p" else ""

    got = {r["ord"]: r for r in chapters.generate_chapters(rows, ask).collect()}
    assert got[0]["title"] == "T" and got[0]["content"] == "# T\n## A\na\nb\nc" and got[0]["error"] is None
    assert got[1]["title"] == "got 65536"


def test_image_choice():
    images = [{"id": i, "ai_description": "d" if i % 2 else None} for i in range(20)]
    answer = lambda prompt, tokens: '{"relevant": true, "placement": null}'
    found = chapters.select_images("draft", images, lambda i: "seen", answer)
    assert [(i["id"], p) for i, p in found] == [(1, "before conclusion"), (3, "before conclusion"), (5, "before conclusion")]
    assert chapters.select_images("draft", images, lambda i: "", lambda p, t: "nothing") == []


def test_files_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"file://{tmp_path}/out/a.md", "é\n"), (f"file://{tmp_path}/out/b/c.json", "{}")], "path string, content string")
    assert len(output.write(rows)) == 2
    assert (tmp_path / "out" / "a.md").read_text() == "é\n" and (tmp_path / "out" / "b" / "c.json").read_text() == "{}"
    found = output.existing_chapters(spark.createDataFrame([("x/cap_2_a.md",), ("cap_9_b.md",), ("cap_x.md",), ("cap_1_c.txt",)], "path string"), 5)
    assert [r["idx"] for r in found.collect()] == [1]
    template = tmp_path / "t.md"
    template.write_text("# {{title}}\n{{content}}")
    assert output.read_template(spark, f"file://{template}").startswith("# {{title}}")
    with pytest.raises(assemble.TemplateNotFoundError):
        output.read_template(spark, f"file://{tmp_path}/none.md")


def test_cache_and_state_admin(spark):
    cache = spark.createDataFrame([("k", "p", "old", "m", 1), ("j", "q", "x", None, 1)], "key string, prompt_preview string, response string, model string, created_at int")
    new = spark.createDataFrame([("k", "p2", "new", "m", 2)], cache.schema)
    rows = {r["key"]: tuple(r) for r in state.save_cache(cache, new).collect()}
    assert rows == {"k": ("k", "p", "new", "m", 2), "j": ("j", "q", "x", None, 1)}
    assert state.without(cache, "model", "m").count() == 1
    st = spark.createDataFrame([("a", "h"), (None, "h"), ("b", None)], "source_path string, content_hash string")
    assert state.invalidate(st, "a").count() == 2 and state.invalidated(st, "a").count() == 1
    assert state.invalidate(st, None, "h").count() == 1 and state.invalidate(st).count() == 0
    prompts = spark.createDataFrame([("m", "p")], "model string, prompt string")
    twice = prompts.select(state.cache_key().alias("key"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("response"))
    assert state.probe(prompts, twice).count() == 1


def test_chapter_numbers():
    assert outline.selected_chapters(" 1,3, x,9 ", 4) == [0, 2]
    assert outline.selected_chapters(" ", 4) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_syllabus_structure_moves_no_lines(spark):
    df = spark.createDataFrame([("a", "x\nChapter 1: One\n- s\n\n2) t\nModule II: Two"), ("b", "flat"), ("c", "")], "k string, t string")
    found = syllabus.syllabus_structure(df, "k", "t")
    assert "Exchange" not in _plan(found) and _plan(found).count("Filter") == 1
    assert [tuple(r) for r in found.orderBy("key", "idx").collect()] == [("a", 0, "One", ["s", "t"]), ("a", 1, "Two", [])]


def test_links_of_a_list_are_checked_in_one_pass(spark):
    md = "# Été\n- [a](#ete)\n\n- [b](#nothing)\n- [c](#ete)\nend\n- [d](#late)"
    found = markdown.checked_links(spark.createDataFrame([("m", md), ("n", "# x"), ("o", "- [a](#a)")], "manual string, md string"))
    plan = _plan(found)
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in found.collect()) == [("m", 0, "ete", False), ("m", 2, "nothing", True), ("m", 3, "ete", False), ("o", 0, "a", True)]


def test_outlines_are_read_once_in_bounded_batches(spark):
    df = spark.createDataFrame([("m", '{"chapters": [{"title": "a", "sections": ["s"]}, {"title": "b"'), ("n", "no outline")], "k string, response string")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    found = generation.parse_outline(df, "k")
    assert _plan(found).count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert [tuple(r) for r in found.collect()] == [("m", 0, "a", ["s"])]
