"""Attempts at a model as a fixpoint over written tables: only rows that failed are asked again.

Each round is a table.  A row that a judge finds unusable comes back with more tokens for its
answer, one that it finds faulty also with what was wrong; the others are done.  The number of
tokens is part of a request's key, so a larger request is not answered from the cache of a
smaller one.  A round whose task is lost is computed again from the round before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.generation import GenerationError
from .storage import Store

#: (model, prompt, tokens for the answer) -> response.
Ask = Callable[[str, str, int], str]
#: Answers (key, response) -> rows (key, verdict, feedback); verdicts are ok, faulty and unusable.
Judge = Callable[[DataFrame], DataFrame]
ATTEMPTS, GROWTH = 3, 2
_REQUEST = ["model", "prompt", "tokens"]


def request_key() -> Column:
    return F.sha2(F.concat_ws("\n", "model", "prompt", F.col("tokens").cast("string")), 256)


def answered(asks: DataFrame, ask: Ask, cache: DataFrame | None, store: Store, name: str) -> DataFrame:
    """`asks` (key, model, prompt, tokens) with `response`, null where the request failed.

    Cached rows (request, response) are not asked again; equal requests are asked once.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    got = ask(*(row.column(c)[0].as_py() for c in _REQUEST))
                except GenerationError:
                    got = None
                yield pa.RecordBatch.from_arrays([row.column("request"), pa.array([got], pa.string())], names=["request", "response"])

    keyed = asks.withColumn("request", request_key())
    wanted = keyed.select("request", *_REQUEST).distinct()
    if cache is not None:
        wanted = wanted.join(cache.select("request"), "request", "left_anti")
    new = store.save(wanted.mapInArrow(call, "request string, response string"), f"{name}_responses")
    known = new if cache is None else new.unionByName(cache.select("request", "response"))
    return store.save(keyed.join(known, "request", "left"), f"{name}_answers")


def fixpoint(
    asks: DataFrame, judge: Judge, ask: Ask, store: Store, name: str, cache: DataFrame | None = None, attempts: int = ATTEMPTS, growth: int = GROWTH
) -> tuple[DataFrame, DataFrame]:
    """(rows (key, response, verdict, feedback, attempts), new cache rows (request, response)).

    After the last attempt a faulty answer is kept with its feedback; an unusable one has no response.
    """
    rows = asks.select("key", "model", "prompt", F.col("tokens").cast("int").alias("tokens"))
    done = fresh = None
    for i in range(1, attempts + 1):
        got = answered(rows, ask, cache, store, f"{name}{i}")
        new = got.where("response IS NOT NULL").select("request", "response").distinct()
        fresh = new if fresh is None else fresh.unionByName(new)
        judged = got.join(judge(got.select("key", "response")), "key", "left").withColumn("attempts", F.lit(i))
        verdict = F.when(F.col("response").isNull(), "unusable").otherwise(F.coalesce("verdict", F.lit("unusable")))
        judged = store.save(judged.withColumn("verdict", verdict), f"{name}{i}_judged")
        over = judged if i == attempts else judged.where("verdict = 'ok'")
        response = F.when(F.col("verdict") != "unusable", F.col("response"))
        over = over.select("key", response.alias("response"), "verdict", "feedback", "attempts")
        done = over if done is None else done.unionByName(over)
        failed = judged.where("verdict <> 'ok'")
        if i == attempts or failed.isEmpty():
            break
        wrong = F.concat(F.lit("\n\nThe last answer had errors:\n- "), F.col("feedback"), F.lit("\nGive the whole corrected JSON."))
        prompt = F.when((F.col("verdict") == "faulty") & F.col("feedback").isNotNull(), F.concat("prompt", wrong)).otherwise(F.col("prompt"))
        rows = failed.select("key", "model", prompt.alias("prompt"), (F.col("tokens") * growth).alias("tokens"))
    return done, fresh.distinct()
