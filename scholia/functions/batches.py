"""How much of a table a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bound_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Keep Arrow batches of whole texts to a few megabytes, whatever the size of a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
