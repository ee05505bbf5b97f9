from pyspark.sql import functions as F

from scholia.functions import llm_json as J
from scholia.functions import text as T
from scholia.functions import unicode as U
from scholia.functions.similarity import ratio


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_slugs(spark):
    pairs = {
        "Vector Spaces": "vector-spaces", "What is C++?": "what-is-c", "  lots   of   spaces  ": "lots-of-spaces",
        "Intégrales et Dérivées": "integrales-et-derivees", "Chapter 3: Basics": "chapter-3-basics",
    }
    df = spark.createDataFrame(list(pairs.items()), "a string, b string")
    assert all(r["x"] == r["b"] for r in df.select("b", U.slug(F.col("a")).alias("x")).collect())


def test_normalize(spark):
    for given, want in (
        ("line1\n\n\n\nline2", "line1\n\nline2"), ("hel\x00lo", "hello"), ("  First line  \n   Second line  \n\n\n  Third  ", "First line\nSecond line\n\nThird"),
        ("  Ciao   mondo  ", "Ciao mondo"), ("a\nendobj\nb", "a\nb"),
    ):
        assert one(spark, U.normalize_text(F.col("t")), t=given) == want


def test_types_and_names(spark):
    df = spark.createDataFrame([("/a/Syllabus.PDF",), ("/b/notes.md",), ("/c/x.tar.gz",), ("/d/none",)], "p string")
    assert [r[0] for r in df.select(T.file_type(F.col("p"))).collect()] == ["pdf", "markdown", "unknown", "unknown"]
    assert [r[0] for r in df.select(T.is_syllabus(F.col("p"))).collect()] == [True, False, False, False]
    names = spark.createDataFrame([("Topic 3",), ("n/a",), ("x",), ("12",), ("Linear Algebra",), (None,)], "n string")
    assert [r[0] for r in names.select(T.is_invalid_name(F.col("n"))).collect()] == [True, True, True, True, False, True]


def test_ratio_is_directed(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("a", "")], "a string, b string")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, 1.0, 0.0]


def test_json_repairs(spark):
    schema = "struct<chapters:array<struct<title:string,sections:array<string>>>>"
    texts = ['{"chapters":[{"title":"A","sections":["x"]}]}', '```json\n{"chapters":[{"title":"A","sections":["x"]}]}\n```',
             'text {"chapters":[{"title":"A","sections":["x"]}]} more', '{"chapters":[{"title":"A","sections":["x"]},{"title":"B","sec', "## Chapter 1: A\n- x"]
    for t in texts:
        got = one(spark, J.parse_json(F.col("t"), schema), t=t)
        assert [(c["title"], c["sections"]) for c in got["chapters"]] == [("A", ["x"])], t
    assert one(spark, J.parse_json(F.col("t"), schema), t="nothing") is None


def test_plain_text_and_paths(spark):
    assert one(spark, T.plain_text(F.col("t")), t="# Head\n\n- **a** [b](c)\n") == "Head\na b"
    assert one(spark, T.image_paths(F.col("t")), t="![a](x.png) ![b](http://y/z.png)") == "![a](output/x.png) ![b](http://y/z.png)"
