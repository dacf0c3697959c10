"""Batches that replace one another without a gap.

A batch is written beside what is there, in a folder of its own. Then one row, appended to the
table of commits, names that folder. Readers take the folder that was committed last for each batch, so
whoever reads sees the old batch or the new one, and a writer that breaks off leaves the old one
in force. Folders that were replaced, or never committed, stay until ``replaced`` names them to whoever clears up.

One writer at a time may write a given batch; different batches may be written at once.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"
COMMIT_SCHEMA = "batch bigint, version bigint, folder string"


def write_batch(folder: str, batch: int, spark: SparkSession, write: Callable[[str], None]) -> None:
    """Have ``write`` fill a new folder, then make that folder the batch."""
    part = f"batch={batch}/write={uuid.uuid4().hex}"
    write(f"{folder}/{part}")
    last = _commits(spark, folder).where(F.col("batch") == batch).agg(F.max("version")).scalar()
    row = spark.range(1).select(
        F.lit(batch).cast("bigint").alias("batch"), (F.coalesce(last, F.lit(0)) + 1).alias("version"), F.lit(part).alias("folder")
    )
    # One row in one file, which appears at once or not at all.
    row.coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}")


def read_batches(spark: SparkSession, folder: str, schema: str, table: str | None = None) -> DataFrame:
    """All committed batches. ``schema`` is that of the rows; a column ``batch`` in it is the batch.

    A batch of several tables has each in a folder ``table=...`` of its own, and one commit for all of them.
    """
    names = spark.createDataFrame([], schema).columns
    part = f"/table={table}" if table else ""
    paths = [f"{folder}/{row.folder}{part}" for row in _in_force(spark, folder).collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
    return found.select(*names)


def replaced(spark: SparkSession, folder: str) -> list[str]:
    """Committed folders that are no longer in force."""
    in_force = _in_force(spark, folder)
    old = _commits(spark, folder).join(in_force, "folder", "left_anti")
    return [f"{folder}/{row.folder}" for row in old.select("folder").distinct().collect()]


def _in_force(spark: SparkSession, folder: str) -> DataFrame:
    return _commits(spark, folder).groupBy("batch").agg(F.max_by("folder", "version").alias("folder"))


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{COMMITS}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(f"{folder}/{COMMITS}")
