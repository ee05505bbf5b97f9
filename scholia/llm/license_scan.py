"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined with the k-grams of the
templates.  A hit at word p of the text and word q of a template votes for the diagonal
p - q; votes are summed by diagonal, neighbouring diagonals (small insertions and
deletions) are merged, and the words of the merged span are compared with the template's
words before a label is given.  The template table is built from constants below and has a
proven size (a few hundred k-grams), so that side is broadcast; the texts are not shuffled,
only hits are.

Defined results: a null or empty text has no words, no places and score 0.  Null ids and
repeated rows are matched through a digest of id and text, and each row gets its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Phrases whose every place counts, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening passages of licences, by label.
TEMPLATES = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "mit-notice": "released under the mit license",
    "mit-header": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "bsd-header": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

#: Words in a k-gram, diagonals apart that still merge, share of a template's words that a
#: span has to hold, and the least votes.
K = 3
SLACK = 3
LEAST_SCORE = 0.7
LEAST_VOTES = 2


def license_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    bare = F.regexp_replace(lower, "^" + NOT_WORD, "")
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(
        F.filter(F.split(bare, NOT_WORD), lambda x: F.length(x) > 0)
    )


def _grams(words: Column, k: int) -> Column:
    return F.when(
        F.size(words) >= k,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - k),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: dict[str, str], k: int = K) -> DataFrame:
    """Rows (gram, label, at, template): one for each k-gram of each template."""
    table = spark.createDataFrame([(a, b.split()) for a, b in templates.items()], "label string, template array<string>")
    return table.select("label", "template", F.posexplode(_grams(F.col("template"), k)).alias("at", "gram"))


def license_spans(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, k: int = K, slack: int = SLACK, least: float = LEAST_SCORE
) -> DataFrame:
    """Verified spans (key, label, start, end, votes, score) of rows (key, words)."""
    # The array is a column first, so that exploding and joining run as one compiled stage
    # and a text's words are copied for hits only.  The outer form keeps the optimiser from
    # adding a filter that would compute the array again; its null rows find no partner.
    grams = docs.withColumn("_grams", _grams(F.col("words"), k)).select(
        "key", "words", F.posexplode_outer("_grams").alias("p", "gram")
    )
    table = template_grams(docs.sparkSession, templates, k)
    # Of a text, only the words that the template could cover around the hit travel on.
    reach = F.size("template") + slack
    first = F.greatest(F.lit(0), F.col("p") - F.col("at") - slack)
    hits = grams.join(F.broadcast(table), "gram").select(
        "key", "label", "template", "p", (F.col("p") - F.col("at")).alias("diagonal"),
        first.alias("from"), F.slice("words", first + 1, reach + slack).alias("near"),
    )
    votes = hits.groupBy("key", "label", "diagonal").agg(
        F.size(F.collect_set("p")).alias("votes"), F.first("template").alias("template"), F.first("near").alias("near"), F.first("from").alias("from")
    )
    by_line = W.partitionBy("key", "label").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(by_line) <= slack, 0).otherwise(1)
    votes = votes.withColumn("_new", new)
    votes = votes.withColumn("run", F.sum("_new").over(by_line.rowsBetween(W.unboundedPreceding, 0)))
    spans = votes.groupBy("key", "label", "run").agg(
        F.sum("votes").alias("votes"), F.max_by("diagonal", F.struct("votes", -F.col("diagonal"))).alias("diagonal"),
        F.max_by(F.struct("near", "from"), F.struct("votes", -F.col("diagonal"))).alias("n"),
        F.first("template").alias("template"),
    ).where(F.col("votes") >= LEAST_VOTES)
    near, template = F.col("n.near"), F.col("template")
    # Verification on words: the template's words found within `slack` of their diagonal.
    found = F.filter(
        F.sequence(F.lit(0), F.size(template) - 1),
        lambda q: F.array_contains(
            F.slice(near, F.greatest(F.lit(1), F.col("diagonal") - F.col("n.from") + q + 1 - slack), F.lit(2 * slack + 1)),
            F.get(template, q),
        ),
    )
    spans = spans.withColumn("_found", found)
    return spans.select(
        "key", "label", "votes",
        F.greatest(F.lit(0), F.col("diagonal") + F.array_min("_found")).cast("long").alias("start"),
        (F.col("diagonal") + F.array_max("_found") + 1).cast("long").alias("end"),
        (F.size("_found") / F.size("template")).alias("score"),
    ).where(F.col("score") >= least)


def license_scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: counts of the base phrases, labels and score."""
    row_key = F.md5(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))))
    docs = df.select(F.col(doc_id).alias("doc_id"), row_key.alias("key"), license_words(F.col(text)).alias("words"))
    words = F.col("words")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    any_base = None
    for phrase in BASE_PHRASES:
        has = F.contains(F.col("_joined"), F.lit(f" {phrase} "))
        any_base = has if any_base is None else any_base | has

    def at(i: Column) -> Column:
        test = None
        for phrase in BASE_PHRASES:
            same = F.lit(True)
            for j, w in enumerate(phrase.split()):
                same = same & (F.get(words, i + j) == w)
            test = same if test is None else test | same
        return F.coalesce(test, F.lit(False))

    places = F.when(any_base, F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)).otherwise(F.array().cast("array<int>"))
    labels = F.array_compact(F.array(*[
        F.when(F.contains(F.col("_joined"), F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE_PHRASES.items()
    ]))
    base = docs.withColumn("_joined", joined).select(
        "doc_id", "key", F.size(words).cast("long").alias("n_words"), places.alias("_places"), labels.alias("_labels")
    )
    found = license_spans(docs.select("key", "words")).groupBy("key").agg(
        F.collect_set("label").alias("_more"), F.max("score").alias("_score")
    )
    out = base.join(found, "key", "left")
    all_labels = F.array_sort(F.array_distinct(F.concat("_labels", F.coalesce("_more", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.get("_places", F.lit(0)).cast("long").alias("first_word"),
        F.get("_places", F.size("_places") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort("_labels"), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
