"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of
the whole corpus.  No source gives more than `max_epochs` times its words; the excess is
shared again by weight until every target fits (water filling).  Within a source the
documents are put in a hash-random order, range-split into buckets of that order, summed
per bucket and cut where the budget ends, to the word.  Targets above the source repeat
whole epochs.

Distribution: the sort key is a uniform hash, so fixed-width ranges of it hold like
numbers of rows; a source that holds a third of all rows is split into proportionally
more buckets.  Bucket sums get their prefix over groups of buckets first, then inside a
group, so that no task sees more than a bounded share of even the bucket table.

Defined results: null or blank texts have size 0 and are taken 0 times; an empty table
gives an empty result; null ids are ordered by the hash of their text; repeated rows stay
separate rows with neighbouring places in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, Columns, Workspace, text_hash

#: Rows aimed at in a bucket of a source's order, and buckets in a group of buckets.
BUCKET_ROWS = 4096
GROUP_BUCKETS = 1024
MAX_EPOCHS = 3
_BIG = "decimal(38,0)"
#: 2 ** 32, the range of the leading hash digits that buckets split.
_RANGE = 1 << 32


def mix_key(doc_id: Column, text: Column) -> Column:
    """Hash-random order of documents: md5 digits of the id, or of the text if it is null."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.coalesce(text, F.lit("")))))


def source_id(source: Column) -> Column:
    """A number for a source, null included."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets by source, from rows (source, source_size, n_docs) with distinct sources.

    Sorted by size per weight, the capped sources are a prefix: those whose share of what
    the capped ones before them leave exceeds their cap.  All comparisons are exact.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weighed = sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("long"))
    # size/weight ascending without division: weights are 1, 2 or 3, so size * 6 / weight is whole.
    weighed = weighed.withColumn(
        "_level", F.col("source_size").cast(_BIG) * F.when(F.col("weight") == 1, 6).when(F.col("weight") == 2, 3).otherwise(2)
    )
    rising = W.orderBy("_level", F.col("source").asc_nulls_last())
    size = F.col("source_size").cast(_BIG)
    before = F.coalesce(F.sum(size * max_epochs).over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(_BIG))
    left = F.sum(size).over(whole) - before
    weights = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    weighed = weighed.withColumns({"_left": left.cast(_BIG), "_weights": weights})
    above = F.col("weight") * F.col("_left") > size * max_epochs * F.col("_weights")
    weighed = weighed.withColumn("_capped", above)
    # The last capped row ends the prefix; what it leaves is shared by the rows after it.
    weighed = weighed.withColumn("_capped", F.max("_capped").over(rising.rowsBetween(0, W.unboundedFollowing)))
    free = ~F.col("_capped")
    weighed = weighed.withColumns({
        "_free_left": F.max(F.when(free, F.col("_left"))).over(whole),
        "_free_weights": F.max(F.when(free, F.col("_weights"))).over(whole),
    })
    shared = F.col("weight").cast("double") * F.col("_free_left").cast("double") / F.col("_free_weights").cast("double")
    target = F.when(F.col("_capped"), (F.col("source_size") * max_epochs).cast("double")).otherwise(shared)
    return weighed.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def mix_sources(
    df: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_epochs: int = MAX_EPOCHS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: doc_id, key, th, sid, size, source, source_size, target, taken.

    `key` is its place in the order, `th` and `sid` are hashes of text and source.  `taken` counts the words that the mix takes from the document, repeats included.
    """
    rows = Workspace(df.sparkSession).save(
        df.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            mix_key(F.col(doc_id), F.col(text)).alias("key"),
            text_hash(F.col(text)).alias("th"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(totals, max_epochs).withColumn("_sid", source_id(F.col("source")))
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        rows["*"], "source_size", "n_docs", "target", "_sid"
    )
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    n_buckets = F.ceil(F.col("n_docs") / bucket_rows)
    joined = joined.withColumn("_bucket", F.floor(place * n_buckets / F.lit(_RANGE)).cast("long"))
    joined = joined.withColumn("_group", F.floor(F.col("_bucket") / GROUP_BUCKETS).cast("long"))
    sums = joined.groupBy("_sid", "_group", "_bucket").agg(F.sum("size").alias("_sum"))
    starts = sums.groupBy("_sid", "_group").agg(F.sum("_sum").alias("_sum"))
    none = F.lit(0).cast("long")
    starts = starts.select("_sid", "_group", F.coalesce(
        F.sum("_sum").over(W.partitionBy("_sid").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)), none).alias("_group_start"))
    sums = sums.select("_sid", "_group", "_bucket", F.coalesce(
        F.sum("_sum").over(W.partitionBy("_sid", "_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), none).alias("_bucket_start"))
    starts = sums.join(starts, ["_sid", "_group"]).select("_sid", "_bucket", (F.col("_group_start") + F.col("_bucket_start")).alias("_start"))
    inside = W.partitionBy("_sid", "_bucket").orderBy("key", "doc_id", "size", "th").rowsBetween(W.unboundedPreceding, -1)
    ordered = joined.withColumn("_inside", F.coalesce(F.sum("size").over(inside), none))
    ordered = ordered.join(starts, ["_sid", "_bucket"]).withColumn("_before", F.col("_start") + F.col("_inside"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(none, rest - F.col("_before")))
    return ordered.select(
        "doc_id", "key", "th", F.col("_sid").alias("sid"), "size", "source", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken")
    )


def mixed_documents(df: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of `df` whatever their names: whole copies for each epoch
    that a document is taken in, and the leading words up to the cut for the one document at a
    budget's end.

    Rows that agree in id, source and text stand next to each other in the mix's order, so what
    is taken of them are at most three numbers, the larger ones first.
    """
    mix = mix_sources(df, max_epochs=max_epochs).select("key", "th", "sid", "size", "taken")
    alike = ["key", "th", "sid"]
    steps = mix.groupBy(*alike, "size", "taken").agg(F.count("*").alias("n"))
    steps = steps.groupBy(*alike, "size").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("steps"))
    steps = steps.where(F.col("steps")[0]["taken"] > 0)
    columns = Columns(df)
    text = columns["text"]
    rows = columns.rows.withColumns({"key": mix_key(columns["doc_id"], text), "th": text_hash(text), "sid": source_id(columns["source"])})
    got = rows.join(steps, alike)
    number = F.row_number().over(W.partitionBy(*alike).orderBy("size"))
    got = got.withColumn("number", F.when(F.size("steps") > 1, number).otherwise(1))
    step = lambda k, c: F.coalesce(F.get("steps", F.lit(k))[c], F.lit(0))
    taken = F.when(F.col("number") <= step(0, "n"), step(0, "taken"))
    taken = taken.when(F.col("number") <= step(0, "n") + step(1, "n"), step(1, "taken")).otherwise(step(2, "taken"))
    got = got.withColumn("taken", F.when(F.size("steps") > 1, taken).otherwise(step(0, "taken"))).where("taken > 0")
    copies = F.transform(
        F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")),
        lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")).cast("int"),
    )
    got = got.withColumn("words", F.explode(copies))
    # The text up to the end of its last word in the budget, by a fold over its pieces between
    # white space (every kind of it is one character, so lengths stay right).
    pieces = F.split(F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS)), " ")
    state = lambda words, chars: F.struct(words.cast("int").alias("words"), chars.cast("int").alias("chars"))
    walked = F.aggregate(
        pieces, state(F.lit(0), F.lit(0)),
        lambda s, p: F.when(s["words"] < F.col("words"), state(s["words"] + F.least(F.lit(1), F.length(p)), s["chars"] + F.length(p) + 1)).otherwise(s),
    )
    whole = F.col("words") == F.col("size")
    got = got.withColumn("cut", F.when(whole, text).otherwise(F.substring(text, F.lit(1), walked["chars"] - 1)))
    changed = {"text": F.col("cut")}
    if "n_chars" in df.columns:
        changed["n_chars"] = F.length("cut").cast(df.schema["n_chars"].dataType)
    return columns.back(got, **changed)
