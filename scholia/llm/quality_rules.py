"""Quality rules: a threshold table compiled into one Spark projection.

No user function runs: every metric is a built-in expression over the row, so the
plan is a scan and projections without any exchange, at any size.

Defined results: a null or empty text has no words, so every count is 0, it fails the
base rules and is not kept.  Null ids and repeated rows are scored row by row.  Columns
of the input that are not asked for are left alone; an input column that has the name
of an output metric is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Columns, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words, by language.
STOP_WORDS = {
    "en": "the of and to in is it that was with for on are as by be this not or at from have an he you",
    "de": "der die und den das von zu ist mit sich auf für im dem nicht ein eine als auch des es an",
    "fr": "le la les de des et en un une du que est pour qui dans par sur pas au avec ce il",
    "es": "el la los las de del que y en un una por con para se su al es lo no como más",
}


class Rule(NamedTuple):
    """A document passes if `metric` lies in [low, high]; None leaves a side open."""

    metric: str
    low: float | None
    high: float | None


#: The method's verdict.  All ratios are over the whole text.
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.30),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.50),
)


def _counts(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    df = df.withColumns({"_w": words_of(F.col(text)), "_lines": lines})
    w = F.col("_w")
    # Windows as hashes of their words with their places: a sort of numbers, not of texts.
    windows = F.sort_array(
        F.when(
            F.size(w) >= 3,
            F.transform(
                F.slice(w, 1, F.size(w) - 2),
                lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    )
    stops = sorted({x for words in STOP_WORDS.values() for x in words.split()})
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(body, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long"),
        "_tri": windows,
    }).drop("_lines")
    tri = F.col("_tri")
    # Equal windows are neighbours once sorted; what is left are the places of repeated ones.
    # Words decide between neighbours with equal hashes.
    word = lambda x, k: F.get(w, x["i"] + k)
    same = lambda x, y: F.coalesce(
        (x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.lit(False))
    again = F.filter(tri, lambda x, j: ((j > 0) & same(x, F.get(tri, j - 1))) | same(x, F.get(tri, j + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_tri", "_w")
    at = F.col("_at")
    covered = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), p + 3) - p))
    return df.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    ).drop("_at")


def _ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column that is true where every rule of the table holds."""
    passed = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            passed = passed & (F.col(rule.metric) >= F.lit(rule.low))
        if rule.high is not None:
            passed = passed & (F.col(rule.metric) <= F.lit(rule.high))
    return passed


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, the ratios, `base_failed` and `kept` to every row of `df`."""
    if text != "_text":
        df = df.withColumn("_text", F.col(text))
    out = _counts(df, "_text").drop("_text")
    out = out.withColumns({
        "mean_word_length": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": _ratio("n_stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def kept_documents(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `df` that the rules keep, whatever the names of its columns.

    The row number keeps the optimiser from moving the filter below the projections, where
    every metric would be computed again inside it.
    """
    columns = Columns(df)
    scored = quality_rules(columns.rows.withColumn("_text", columns["text"]), "_text", rules)
    scored = scored.withColumn("number", F.monotonically_increasing_id())
    return columns.back(scored.where(F.col("kept") & (F.col("number") >= 0)))
