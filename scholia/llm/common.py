"""Helpers that the training-data operators share: shared-folder tables, group
streaming over sorted partitions, and the word class of the contracts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers that one file holds where a table's size is bounded beforehand.
FILE_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the `WORD` matches of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


class Columns:
    """The columns of a table under names of their own, so that an operator's cannot clash."""

    def __init__(self, df: DataFrame):
        self.given = df.columns
        self.own = [f"column{i}" for i in range(len(self.given))]
        self.rows = df.toDF(*self.own)

    def __getitem__(self, name: str) -> Column:
        return F.col(self.own[self.given.index(name)])

    def back(self, df: DataFrame, **changed: Column) -> DataFrame:
        """The columns under their given names, `changed` ones replaced."""
        return df.select(*(
            (changed[g] if g in changed else F.col(o)).alias(g) for g, o in zip(self.given, self.own, strict=True)))


def text_hash(text: Column) -> Column:
    """64 bits of a text, which tell rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a folder set here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Keep Arrow batches of whole texts to a few megabytes on both sides of the Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


class Workspace:
    """Parquet tables in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/scholia-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write a table and read it again.  With a proven bound of its rows, a table that needs
        fewer files than the session has shuffle partitions gets as many as the bound asks for."""
        path = f"{self.base}/{name}"
        if rows is not None:
            files = -(-max(1, rows) // FILE_ROWS)
            if files < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.repartition(files)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the consecutive rows with one key, from a partition sorted by it.

    Only one group is held at a time; callers bound a group's size by salting.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        start = 0
        for i, k in enumerate(keys):
            if k != last and (held or i > start):
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start = [], i
            last = k
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
