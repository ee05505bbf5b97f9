"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from scholia.oracle import SQL
from scholia.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, df[columns].astype(str).sort_values(columns).values.tolist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_near_copies_of_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["ord"] for r in QUERIES["dedup_near"](spark, sf).collect()}
    assert kept < {r["doc_id"] for r in docs.select("doc_id").collect()}
    # Brute force: no two texts that are left reach the ratio, whatever their order.
    from difflib import SequenceMatcher

    texts = [r["text"] for r in docs.where(docs["doc_id"].isin(sorted(kept))).orderBy("doc_id").collect()]
    for j, b in enumerate(texts):
        for a in texts[:j]:
            if 2 * min(len(a), len(b)) >= 0.92 * (len(a) + len(b)):
                m = SequenceMatcher(None, a, b)
                assert m.quick_ratio() < 0.92 or m.ratio() < 0.92
