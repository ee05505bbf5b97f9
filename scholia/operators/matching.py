"""Keyword and best-match joins between topics, chunks, entries, chapters and images.

Topic-like tables are small by nature, but no keyword join relies on it: keywords meet the
chunks' tokens through a gram index, scores are built-in expressions, and best matches are
grouped maxima.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.storage import Store


def chunks_by_id(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that a topic (ord, chunk_ids) lists."""
    listed = topics.select("ord", F.explode("chunk_ids").alias("id")).distinct()
    return chunks.join(listed, "id").select("ord", "id")


def chunks_by_document(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    listed = topics.select("ord", F.explode("related_documents").alias("document_id")).distinct()
    return chunks.join(listed, "document_id").select("ord", "id")


#: Letters of a keyword that the token index looks up.
GRAM = 4


def _containing(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct pairs of a token (t) and a keyword (k) that it contains, for keywords of `GRAM`
    letters or more: an equi-join of the tokens' grams with the keywords' first ones."""
    at = F.sequence(F.lit(1), F.length("t") - GRAM + 1)
    grams = F.array_distinct(F.transform(at, lambda i: F.substring(F.col("t"), i, F.lit(GRAM))))
    index = tokens.where(F.length("t") >= GRAM).select("t", F.explode(grams).alias("gram"))
    wanted = keywords.select("k", F.substring("k", 1, GRAM).alias("gram"))
    return index.join(wanted, "gram").where(F.contains("t", "k")).select("t", "k").distinct()


def chunks_by_keyword(topics: DataFrame, chunks: DataFrame, longer_than: int = 3) -> DataFrame:
    """Chunks that contain any of a topic's keywords; a topic without keywords stands for itself.

    A keyword has no white space, so it stands within one of a chunk's tokens; distinct tokens
    are looked up by grams.  The tokens that name topics are written first: their size is known
    then, so where they are few, the chunks' tokens meet them without being shuffled.  A chunk's
    topics are bits of words of 64 places (`ord` is a whole number), so a few rows of a chunk are
    moved, however many of its tokens name a topic.  Only names that have no keyword, and keywords
    shorter than a gram, are compared with whole chunks.
    """
    words = T.space_keywords(F.col("name"), longer_than)
    named = topics.select("ord", F.when(F.size(words) > 0, words).otherwise(F.array(F.lower("name"))).alias("ks"))
    keys = named.select("ord", F.explode("ks").alias("k")).distinct()
    lowered = chunks.select("id", F.lower("content").alias("lowered"))
    # An outer explode: for a plain one the optimiser would cut each text twice, once in a test of the array's size.
    held = lowered.select("id", F.explode_outer(F.array_distinct(F.split("lowered", r"(?U)\s+"))).alias("t")).where(F.length("t") >= GRAM)
    usual = (F.length("k") >= GRAM) & ~F.rlike("k", F.lit(r"(?U)\s"))
    pairs = _containing(held.select("t").distinct(), keys.where(usual).select("k").distinct())
    word, bits = F.shiftright(F.col("ord").cast("long"), 6).alias("word"), F.expr("shiftleft(1L, cast(ord & 63 AS INT))").alias("bits")
    naming = pairs.join(keys, "k").select("t", word, bits).groupBy("t", "word").agg(F.bit_or("bits").alias("bits"))
    naming = Store(topics.sparkSession).save(naming, "naming_tokens")
    odd = lowered.join(keys.where(~usual), F.contains("lowered", "k")).select("id", word, bits)
    found = held.join(naming, "t").select("id", "word", "bits").unionByName(odd).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)
    ords = found.select("id", "word", F.explode_outer(places).alias("bit"))
    return ords.select((F.col("word") * 64 + F.col("bit")).cast(topics.schema["ord"].dataType).alias("ord"), "id")


def chunks_for_topics(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first tier with hits for each topic: by chunk id, by document, by keyword.

    A tier only looks for the topics that the tiers before it left, so the last and largest one
    need not be compared with them.
    """
    by_id = chunks_by_id(topics, chunks).distinct()
    left = topics.join(by_id.select("ord").distinct(), "ord", "left_anti")
    by_document = chunks_by_document(left, chunks).distinct()
    left = left.join(by_document.select("ord").distinct(), "ord", "left_anti")
    tiers = enumerate((by_id, by_document, chunks_by_keyword(left, chunks)), start=1)
    return reduce(DataFrame.unionByName, (found.select("ord", "id", F.lit(n).alias("tier")) for n, found in tiers))


def entry_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) >= 2))


def _containing_names(names: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct pairs of a name (t) and a key (k) within it, of any length: an equi-join on the key's first letters."""
    index, wanted = None, keys.where(F.length("k") > 0).select("k", F.least(F.length("k"), F.lit(GRAM)).alias("len"))
    for n in range(1, GRAM + 1):
        at = F.sequence(F.lit(1), F.length("t") - n + 1)
        width = F.lit(n)
        grams = F.array_distinct(F.transform(at, lambda i: F.substring(F.col("t"), i, width)))  # noqa: B023
        rows = names.where(F.length("t") >= n).select("t", F.lit(n).alias("len"), F.explode(grams).alias("gram"))
        index = rows if index is None else index.unionByName(rows)
    found = index.join(wanted.withColumn("gram", F.substring("k", F.lit(1), F.col("len"))), ["len", "gram"])
    return found.where(F.contains("t", "k")).select("t", "k").distinct()


def best_match(left: DataFrame, right: DataFrame, words, least: float, strict: bool = False) -> DataFrame:  # noqa: ANN001
    """For names (ord, a) the entry (idx, b) that a pass over the entries ends with, and its score.

    The first equal name wins with 2.  Else entries are seen in turn: one that holds the name, or is held
    by it, becomes the best with shorter / longer if that exceeds the best so far; if not, shared words
    over the larger set of words may exceed it.  Only entries that share a word or hold each other meet
    (by equi-joins), and only their numbers are folded.
    """
    lower = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    x, y = left.select("ord", lower(F.col("a")).alias("a")), right.select("idx", lower(F.col("b")).alias("b"))
    names = lambda d, c, to: d.select(F.col(c).alias(to)).distinct()
    held = _containing_names(names(y, "b", "t"), names(x, "a", "k")).select(F.col("k").alias("a"), F.col("t").alias("b"))
    held = held.unionByName(_containing_names(names(x, "a", "t"), names(y, "b", "k")).select(F.col("t").alias("a"), F.col("k").alias("b"))).distinct()
    within = held.withColumn("within", F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b")))
    within = x.join(within, "a").join(y, "b").select("ord", "idx", "within", (F.col("a") == F.col("b")).alias("same"), F.lit(0.0).alias("shared"))
    wx, wy = x.select("ord", words(F.col("a")).alias("w")), y.select("idx", words(F.col("b")).alias("w"))
    sized = lambda d, key, n: d.select(key, F.size("w").alias(n), F.explode("w").alias("w"))
    both = sized(wx, "ord", "n").join(sized(wy, "idx", "m"), "w").groupBy("ord", "idx").agg((F.count("*") / F.greatest(F.first("n"), F.first("m"))).alias("shared"))
    both = both.select("ord", "idx", F.lit(0.0).alias("within"), F.lit(False).alias("same"), "shared")
    scored = within.unionByName(both).groupBy("ord", "idx").agg(*(F.max(c).alias(c) for c in ("same", "within", "shared")))
    seen = F.sort_array(F.collect_list(F.struct("idx", "same", "within", "shared")))
    state = lambda idx, score: F.struct(idx.cast("long").alias("idx"), score.cast("double").alias("score"))

    def step(best, e):  # noqa: ANN001, ANN202
        better = F.when(e["within"] > best["score"], state(e["idx"], e["within"])).when(e["shared"] > best["score"], state(e["idx"], e["shared"]))
        return F.when(best["score"] == 2, best).when(e["same"], state(e["idx"], F.lit(2.0))).otherwise(F.coalesce(better, best))

    best = scored.groupBy("ord").agg(F.aggregate(seen, state(F.lit(-1), F.lit(0.0)), step).alias("best"))
    reached = F.col("best.score") > least if strict else F.col("best.score") >= least
    return best.where(reached).select("ord", F.col("best.idx").cast(right.schema["idx"].dataType).alias("idx"), F.col("best.score").alias("score"))


def match_entries(topics: DataFrame, entries: DataFrame, least: float = 0.2) -> DataFrame:
    """Topics (ord, name) with their syllabus entry (idx, title)."""
    return best_match(topics.select("ord", F.col("name").alias("a")), entries.select("idx", F.col("title").alias("b")), entry_words, least)


def closest_topic(focus: str, topics: DataFrame) -> DataFrame:
    """The topic nearest to a focus; any positive score will do."""
    left = topics.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit(focus).alias("a"))
    return best_match(left, topics.select(F.col("ord").alias("idx"), F.col("name").alias("b")), lambda c: T.space_keywords(c, 0), 0.0, strict=True)


def content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) > 3))


def chapter_topics(chapters: DataFrame, topics: DataFrame, *keys: str) -> DataFrame:
    """Chapters (idx, title, sections) with the topics that share two words, or one if a topic has three at most."""
    mine = content_words(F.concat_ws(" ", "title", F.concat_ws(" ", "sections")))
    theirs = content_words(F.concat_ws(" ", "name", "description"))
    left = chapters.select(*keys, "idx", F.explode(mine).alias("w"))
    right = topics.select(*keys, "ord", theirs.alias("ws")).select(*keys, "ord", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    common = left.join(right, [*keys, "w"]).groupBy(*keys, "idx", "ord").agg(F.count("*").alias("common"), F.first("n").alias("n"))
    return common.where((F.col("common") >= 2) | (F.col("n") <= 3)).select(*keys, "idx", "ord", "common")


def covered_syllabus(topics: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Topics in syllabus order, entries that no topic covers, then topics outside the syllabus."""
    matched = match_entries(topics, entries)
    placed = topics.join(matched, "ord", "left")
    known = placed.where("idx IS NOT NULL").select("ord", "name", "related_documents", F.col("idx").alias("syllabus_position"),
                                                   F.lit(False).alias("missing_from_notes"), F.lit(False).alias("extra_in_notes"))
    extra = placed.where("idx IS NULL").select("ord", "name", "related_documents", F.lit(None).cast("int").alias("syllabus_position"),
                                               F.lit(False).alias("missing_from_notes"), F.lit(True).alias("extra_in_notes"))
    missing = entries.join(matched.select("idx").distinct(), "idx", "left_anti")
    as_topics = missing.select(F.col("idx").alias("ord"), F.col("title").alias("name"))
    found = chunks_by_keyword(as_topics, chunks, 1).join(chunks.select("id", "document_id"), "id")
    documents = found.groupBy("ord").agg(F.sort_array(F.collect_set("document_id")).alias("related_documents"))
    fallback = as_topics.join(documents, "ord", "left").select(
        "ord", "name", F.coalesce("related_documents", F.array().cast("array<string>")).alias("related_documents"),
        F.col("ord").cast("int").alias("syllabus_position"), F.col("related_documents").isNull().alias("missing_from_notes"),
        F.lit(False).alias("extra_in_notes"))
    return known.unionByName(fallback).unionByName(extra)


def images_for_topics(topics: DataFrame, images: DataFrame, most: int = 3) -> DataFrame:
    """The images whose caption and file stem share most keywords with a topic, `most` each."""
    from pyspark.sql import Window as W

    left = topics.select("ord", T.keywords(F.concat_ws(" ", "name", "description")).alias("_wt"))
    right = images.select("id", F.col("ord").alias("image_ord"), T.keywords(F.concat_ws(" ", "caption", T.file_stem(F.col("file_path")))).alias("_wi"))
    words = left.select("ord", F.explode("_wt").alias("w")).join(right.select("id", "image_ord", F.explode("_wi").alias("w")), "w")
    scored = words.groupBy("ord", "id", "image_ord").agg(F.count("*").alias("score"))
    rank = F.row_number().over(W.partitionBy("ord").orderBy(F.desc("score"), "image_ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)
