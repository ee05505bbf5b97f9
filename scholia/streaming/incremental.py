"""New study material as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.chunking import create_chunks
from ..sources.files import classify, read_text

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Files that appear below a folder, each once by the checkpoint's record."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    files = reader.load(folder)
    return files.select(
        T.stable_id(F.col("path")).alias("id"), F.col("path").alias("source_path"), T.file_type(F.col("path")).alias("file_type"),
        "content", T.sha256(F.col("content")).alias("content_hash"), F.col("modificationTime").alias("seen_at"),
    ).where("file_type <> 'unknown'")


def chunk_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks of plain text files; a micro-batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        plain = batch.where(F.col("file_type").isin("txt", "markdown")).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
        create_chunks(plain, "id", "text").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly counts of seen files by type, with late files up to a bound."""
    return files.withWatermark("seen_at", late).groupBy(F.window("seen_at", "1 hour"), "file_type").agg(F.count("*").alias("n_files"))


class StudyState:
    """What a stream of files has seen, as an append-only log of states by epoch; a path's last one counts.

    An epoch that is repeated reads the log without its own rows and overwrites its folders, so
    it ends in the same state.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, epoch long").parquet(f"{self.folder}/{name}")

    def states(self, before: int | None = None) -> DataFrame:
        """The last state (source_path, content_hash, change, updated_at) of each path, before an epoch or now."""
        from pyspark.errors import AnalysisException

        schema = "source_path string, content_hash string, change string, updated_at timestamp"
        try:
            log = self._log("states", schema)
        except AnalysisException:
            log = self.spark.createDataFrame([], f"{schema}, epoch long")
        log = log if before is None else log.where(F.col("epoch") < before)
        last = log.groupBy("source_path").agg(F.max_by(F.struct("content_hash", "change", "updated_at"), "epoch").alias("s"))
        return last.select("source_path", "s.*")

    def chunks(self) -> DataFrame:
        """The chunks of each file's present content; those of contents that were replaced are left out."""
        log = self._log("chunks", "id string, document_id string, content string, position int, n_tokens long, content_hash string, source_path string")
        now = self.states().select("source_path", "content_hash")
        newest = log.groupBy("source_path", "content_hash").agg(F.max("epoch").alias("epoch"))
        return log.join(now, ["source_path", "content_hash"], "left_semi").join(newest, ["source_path", "content_hash", "epoch"], "left_semi")

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Classifies a batch of files (path, modified, content) and chunks those that are new or modified."""
        files = batch.select(
            T.stable_id(F.col("path")).alias("id"), F.col("path").alias("source_path"), T.file_type(F.col("path")).alias("file_type"), "content",
            T.sha256(F.col("content")).alias("content_hash"), F.col("modified").alias("updated_at"))
        known = self.states(before=epoch)
        seen = classify(files, known.select("source_path", "content_hash", "updated_at"))
        states = seen.select("source_path", "content_hash", "change", "updated_at", F.lit(epoch).cast("long").alias("epoch"))
        changed = read_text(seen.where("change <> 'unchanged'"))
        chunks = create_chunks(changed, "id", "text").join(changed.select(F.col("id").alias("document_id"), "content_hash", "source_path"), "document_id")
        chunks.withColumn("epoch", F.lit(epoch).cast("long")).select(
            "id", "document_id", "content", "position", "n_tokens", "content_hash", "source_path", "epoch").write.mode("overwrite").parquet(f"{self.folder}/chunks/batch={epoch}")
        states.write.mode("overwrite").parquet(f"{self.folder}/states/batch={epoch}")


def state_stream(spark: SparkSession, folder: str, state: StudyState, checkpoint: str) -> StreamingQuery:
    """Keeps a folder's state: files that are new, modified or unchanged since they were last seen."""
    from ..sources.datasource import StudySource

    spark.dataSource.register(StudySource)
    stream = spark.readStream.format("study").load(folder)
    return stream.writeStream.foreachBatch(state.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
