"""The pipeline's stages by their own promises, on the smallest table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm.common import Workspace


@pytest.fixture(scope="module")
def docs_with_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 50")
    none = docs.limit(3).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    again = docs.where("doc_id < 8").withColumn("source", F.lit(None).cast("string"))
    other = docs.where("doc_id < 5").withColumn("text", F.concat(F.reverse("text"), F.lit(" the of and to")))
    nameless = docs.where("doc_id BETWEEN 8 AND 12").withColumn("doc_id", F.lit(None).cast("long"))
    blank = docs.where("doc_id = 1").withColumn("text", F.lit(" \t\n"))
    long = docs.where("doc_id = 2").withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 60))
    rows = docs
    for more in (none, again, again, other, nameless, nameless, blank, long):
        rows = rows.unionByName(more)
    return rows.withColumns({c: F.lit(c) for c in ("_w", "places", "taken", "key", "doc", "th", "number")})


def test_stages(spark, sf):
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = space.save(stage(spark, docs, sf), f"s{i}")
        if i < 4:
            assert out.columns == docs.columns
        counts.append(out.count())
        if i == 0:
            from scholia.llm.quality_rules import quality_rules

            assert counts[0] == quality_rules(docs).select("kept").toPandas()["kept"].sum()
        docs = out
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and all(counts)
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_on_odd_tables(spark, docs_with_odd_rows, sf):
    """Nulls, blank and long texts, repeated ids and rows, clashing columns: each stage keeps its promise."""
    for df in (docs_with_odd_rows, docs_with_odd_rows.limit(0)):
        space, docs = Workspace(spark), df
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = space.save(stage(spark, docs, sf), f"o{i}")
            if i < 4:
                assert docs.columns == before.columns, name
            if i < 3:
                assert docs.count() <= before.count()
        if df is docs_with_odd_rows:
            assert docs.count() > 0 and docs.where(F.col("length") > 2048).count() == 0
        else:
            assert docs.count() == 0
