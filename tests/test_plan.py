"""Attempts as a fixpoint, and the run from documents to a checked manual with a stub model."""

import json
import sys
import uuid
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scholia.operators import generation
from scholia.plans import study
from scholia.plans.attempts import fixpoint
from scholia.plans.storage import Run, Store, fingerprint


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Stub:
    """A model whose calls leave a file each; answers are chosen by the prompt and its tokens."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer

    def __call__(self, model, prompt, tokens):
        (Path(self.folder) / uuid.uuid4().hex).write_text(json.dumps([prompt, tokens]))
        return self.answer(prompt, tokens)

    def calls(self):
        return sorted((json.loads(p.read_text()) for p in Path(self.folder).iterdir()), key=lambda c: (c[0][:8], c[1]))


def test_only_failed_rows_are_asked_again(spark, tmp_path):
    good = json.dumps({"topics": [{"name": "A"}]})

    def answer(prompt, tokens):
        if prompt == "down":
            raise generation.TimedOut("late")
        return good if prompt == "easy" or prompt == "hard" and tokens == 400 else "no json"

    ask = Stub(tmp_path, answer)
    asks = spark.createDataFrame([("a", "m", "easy", 100), ("b", "m", "hard", 100), ("c", "m", "never", 100), ("d", "m", "easy", 100), ("e", "m", "down", 100)], "key string, model string, prompt string, tokens int")
    done, cache = fixpoint(asks, generation.judge_topics, ask, Store(spark), "t")
    got = {r["key"]: (r["verdict"], r["attempts"], r["response"]) for r in done.collect()}
    assert got == {"a": ("ok", 1, good), "d": ("ok", 1, good), "b": ("ok", 3, good), "c": ("unusable", 3, None), "e": ("unusable", 3, None)}
    counts = {p: [t for q, t in ask.calls() if q == p] for p in ("easy", "hard", "never", "down")}
    # Equal requests are one call; a failing row is asked three times, with more tokens each time.
    assert counts == {"easy": [100], "hard": [100, 200, 400], "never": [100, 200, 400], "down": [100, 200, 400]}
    # A cached answer of a smaller request is no answer to a larger one.
    again, _ = fixpoint(asks, generation.judge_topics, ask, Store(spark), "t", cache=cache)
    assert {r["key"]: r["attempts"] for r in again.collect()}["b"] == 3 and len(ask.calls()) == 10 + 3


def test_feedback_reaches_the_prompt(spark, tmp_path):
    both = json.dumps({"Chapters": [{"title": "Alpha rules", "sections": [{"title": "Sorting things"}, "x ", 3]}, {"title": ""}]})
    ask = Stub(tmp_path, lambda p, t: json.dumps({"chapters": [{"title": "Alpha rules"}]}) if "missing: Sorting" not in p else both)
    topics = spark.createDataFrame([("m", 0, "Alpha rules", "", False), ("m", 1, "Sorting", "", False), ("m", 2, "Unknown thing", "", True)],
                                   "key string, ord int, name string, description string, missing_from_notes boolean")
    asks = spark.createDataFrame([("m", "x", "outline", 10)], "key string, model string, prompt string, tokens int")
    done = fixpoint(asks, generation.judge_outlines(topics), ask, Store(spark), "o")[0].first()
    assert done["verdict"] == "ok" and done["attempts"] == 2 and [t for _, t in ask.calls()] == [10, 20]
    rows = generation.parse_outline(spark.createDataFrame([(both,)], "response string")).collect()
    assert [(r["idx"], r["title"], r["sections"]) for r in rows] == [(0, "Alpha rules", ["Sorting things", "x"])]
    wrong = spark.createDataFrame([(json.dumps({"error": "busy"}),), ("[]",), (None,)], "response string")
    assert wrong.where(generation.read_outline(F.col("response"))["error"].isNull()).count() == 0
    # After the last attempt a faulty outline is kept with what it lacks.
    kept = fixpoint(asks, generation.judge_outlines(topics), Stub(tmp_path, lambda p, t: json.dumps({"chapters": [{"title": "Alpha rules"}]})), Store(spark), "p")[0].first()
    assert kept["verdict"] == "faulty" and "Sorting" in kept["feedback"] and kept["response"]


NOTES = "Bayes rule gives the posterior from the prior and the likelihood of data. " * 3, "Gradient descent follows the slope of the loss function in small steps. " * 3
PLAN = "Chapter 1: Bayes rule\n1. Prior\n2. Posterior\nChapter 2: Gradient descent\n- Steps\nChapter 3: Kernel methods\n- Mercer"


def model(prompt, tokens):
    if prompt.startswith("Read the study"):
        return json.dumps({"topics": [{"name": "Bayes rule", "description": "posterior"}, {"name": "Gradient descent"}, {"name": "Loss function"}]})
    if prompt.startswith("Arrange"):
        return json.dumps({"chapters": [{"title": "Bayes rule and gradient descent", "sections": ["Loss function"]}]})
    title = prompt.split("Topic: ")[1].split("\n")[0]
    heads = [s for s in prompt.split("Sections: ")[1].split("\n")[0].split("; ") if s]
    body = "\n\n".join(f"## {h}\n\nText about {h} of {title}.\nMore of the text.\nAnd the end." for h in heads or ["Body"])
    return json.dumps({"title": title, "content": f"# {title}\n\n{body}", "sections": heads})


def documents(spark, plan=True, more=()):
    rows = [("a", "/a.md", NOTES[0], False, 0), ("b", "/b.md", NOTES[1], False, 1), ("c", "/copy.md", NOTES[0], False, 2), *([("s", "/syllabus.md", PLAN, True, 3)] if plan else []), *more]
    return spark.createDataFrame(rows, "id string, source_path string, content string, is_syllabus boolean, ord long")


def test_from_documents_to_a_manual(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    ask, seen = Stub(tmp_path / "calls", model), []
    run = Run(spark, f"{tmp_path}/run", lambda step, ran: seen.append((step, ran)))
    out = study.manual(documents(spark), run, ask, "m", "2024-01-01")
    steps = ["chunks", "syllabus", "topics", "outline", "chapters", "manual", "checks"]
    assert seen == [(s, True) for s in steps]
    assert {r["document_id"] for r in out["chunks"].collect()} == {"b", "c"}  # of equal texts the longest path stays
    names = [(r["name"], r["missing_from_notes"], r["extra_in_notes"]) for r in out["topics"].orderBy("ord").collect()]
    assert names == [("Bayes rule", False, False), ("Gradient descent", False, False), ("Kernel methods", True, False), ("Loss function", False, True)]
    chapters = [(r["title"], r["sections"]) for r in out["outline"].orderBy("idx").collect()]
    assert chapters == [("Bayes rule", ["Prior", "Posterior"]), ("Gradient descent", ["Steps"]), ("Kernel methods", ["Mercer"])]
    md = out["manual"].first()["md"]
    assert md.index("# 1. Bayes rule") < md.index("## Posterior") < md.index("# 2. Gradient descent") < md.index("# 3. Kernel methods") and "notes hold nothing" in md
    assert {"markdown_structure", "toc_structure"} <= {r["check"] for r in out["checks"].collect()}
    n = len(ask.calls())
    # The same documents: every step is read.
    seen.clear()
    study.manual(documents(spark), run, ask, "m", "2024-01-01")
    assert seen == [(s, False) for s in steps] and len(ask.calls()) == n
    # A further copy changes the documents, but neither chunks nor what follows from them.
    seen.clear()
    again = study.manual(documents(spark, more=[("d", "/d", NOTES[1], False, 9)]), run, ask, "m", "2024-01-01")
    assert dict(seen) == {"chunks": True, "syllabus": True} | {s: False for s in steps[2:]} and len(ask.calls()) == n
    assert fingerprint(again["manual"]) == fingerprint(out["manual"])


def test_without_syllabus_and_with_focus(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    ask = Stub(tmp_path / "calls", model)
    out = study.manual(documents(spark, plan=False), Run(spark, f"{tmp_path}/one"), ask, "m", "2024-01-01")
    assert [(r["title"], r["topic_ords"]) for r in out["outline"].collect()] == [("Bayes rule and gradient descent", [0, 1, 2])]
    one = study.manual(documents(spark, plan=False), Run(spark, f"{tmp_path}/two"), ask, "m", "2024-01-01", focus="gradient descent")
    assert [r["name"] for r in one["topics"].collect()] == ["Gradient descent"] and one["topics"].first()["subtopic_count"] == 1
    assert [r["title"] for r in one["outline"].collect()] == ["Gradient descent"] and "scope topic" in one["manual"].first()["md"]
    with pytest.raises(study.TopicNotFoundError):
        study.manual(documents(spark, plan=False), Run(spark, f"{tmp_path}/three"), ask, "m", "2024-01-01", focus="zzz")
