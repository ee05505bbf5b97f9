"""Processing state and response cache as tables with last-writer-wins keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str = "updated_at", created: str | None = "created_at") -> DataFrame:
    """One row for each key, the latest; the first creation time stays.

    An aggregate with map-side combine: a key with many versions shuffles one row a task.
    """
    both = old.unionByName(new)
    row = F.struct(*[F.col(c) for c in both.columns])
    latest = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, stamp).alias("row"), *([F.min(created).alias("_created")] if created else []))
    out = latest.select("row.*", *(["_created"] if created else []))
    return out.withColumn(created, F.col("_created")).drop("_created") if created else out


def latest_hashes(state: DataFrame) -> DataFrame:
    return state.groupBy("source_path").agg(F.max_by("content_hash", "updated_at").alias("content_hash"))


def invalidated(state: DataFrame, source_path: str | None = None, content_hash: str | None = None) -> DataFrame:
    """The rows that `invalidate` takes away: a path's, else a hash's, else all; their number is its count."""
    if source_path is not None:
        return state.where(F.col("source_path") == source_path)
    if content_hash is not None:
        return state.where(F.col("content_hash") == content_hash)
    return state


def invalidate(state: DataFrame, source_path: str | None = None, content_hash: str | None = None) -> DataFrame:
    """State without a path's rows, or a hash's, or without any; rows without the value stay."""
    if source_path is not None:
        return state.where(~F.col("source_path").eqNullSafe(source_path))
    if content_hash is not None:
        return state.where(~F.col("content_hash").eqNullSafe(content_hash))
    return state.limit(0)


def lookup(rows: DataFrame, column: str, value) -> DataFrame:  # noqa: ANN001
    """The row of a key (a document by id or hash, a state by content hash), or none."""
    return rows.where(F.col(column) == value).limit(1)


def without(rows: DataFrame, column: str, value) -> DataFrame:  # noqa: ANN001
    """Rows after the deletion of a key's, or of a model's cache rows; null keys stay."""
    return rows.where(~F.col(column).eqNullSafe(value))


def previous_models(state: DataFrame) -> DataFrame:
    return state.where("model IS NOT NULL").select("model").distinct()


def latest_topics(state: DataFrame) -> DataFrame:
    """The topics of the state that was updated last, among those that have topics."""
    return state.where("topics_json IS NOT NULL").agg(F.max_by("topics_json", "updated_at").alias("topics_json"))


def with_topics(state: DataFrame, topics_json: str) -> DataFrame:
    """Every row of the state with new topics."""
    return state.withColumn("topics_json", F.lit(topics_json))


def chunks_to_json(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks (key, position, ...) as one JSON text for each key."""
    rows = F.sort_array(F.collect_list(F.struct("position", *[c for c in chunks.columns if c not in (key, "position")])))
    return chunks.groupBy(key).agg(F.to_json(rows).alias("chunks_json"))


def chunks_from_json(state: DataFrame, key: str, fields: str = "position int, id string, content string") -> DataFrame:
    return state.select(key, F.inline(F.from_json("chunks_json", f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")))


def reused_chunks(files: DataFrame, state: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files with the chunks of their content hash's state, files to parse again)."""
    known = state.where(F.col("chunks_json").isNotNull() & ~F.lit(force)).select("content_hash", "chunks_json").dropDuplicates(["content_hash"])
    return files.join(known, "content_hash"), files.join(known, "content_hash", "left_anti")


def all_chunks(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of unchanged files first, then those of parsed ones."""
    return cached.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))


def cache_key(model: str = "model", prompt: str = "prompt"):  # noqa: ANN201
    return T.prompt_key(F.col(model), F.col(prompt))


def probe(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts (model, prompt) with their cached response, null on a miss; a key's last row counts."""
    last = F.max_by("response", "created_at") if "created_at" in cache.columns else F.max("response")
    known = cache.groupBy("key").agg(last.alias("response"))
    return prompts.withColumn("key", cache_key()).join(known, "key", "left")


def save_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each key, the latest; the first row's preview stays."""
    both = cache.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    return both.groupBy("key").agg(
        F.min_by("prompt_preview", F.struct(-F.col("_old"), "created_at")).alias("prompt_preview"),
        *(F.max_by(c, F.struct(-F.col("_old"), "created_at")).alias(c) for c in ("response", "model")),
        F.max("created_at").alias("created_at"))


def misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    return prompts.withColumn("key", cache_key()).join(cache.select("key"), "key", "left_anti")


def to_cache(answers: DataFrame, stamp: str) -> DataFrame:
    """Cache rows of answered prompts (model, prompt, response)."""
    preview = F.regexp_replace(F.substring("prompt", 1, 200), "\n", " ")
    return answers.select(cache_key().alias("key"), preview.alias("prompt_preview"), "response", "model", F.to_timestamp(F.lit(stamp)).alias("created_at"))
