"""A corpus pipeline of five stages: rules, near copies, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept;
its result is written as Parquet and read again as the next stage's `docs`.  All stages but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.llm.best_fit_packing import pack_documents
from scholia.llm.common import Workspace, table
from scholia.llm.mix_sources import mixed_documents
from scholia.llm.ngram_join import one_of_each
from scholia.llm.quality_rules import kept_documents
from scholia.llm.suffix_dedup import deduplicated


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return one_of_each(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier in the corpus."""
    return deduplicated(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated by epoch, cut where a source's budget ends."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    # A small cache: idle workers of this stage stay beside the stages of a next run.
    return pack_documents(docs, cache_pieces=50_000)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", passages_stage),
    ("mixing sources to target weights", mixture_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the joins on similarity, the exact suffix removal and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    space = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.save(docs, f"stage{i}")
    return docs
