"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail.sources.shared import stored

#: The white space that ends a word, and that exact duplicates may differ in.
WHITE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever its letter case rules."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """The column of that very name, also if it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forget(spark: SparkSession, *folders: str) -> None:
    """Delete intermediate folders that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hex_digest(text: Column) -> Column:
    """Lower-case SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its position in a global order, from 0, without sorting in one task.

    Range partitions are sorted and numbered each for itself and written; the numbers of rows
    before each, one row per partition, are then added.
    """
    part, place, before = fresh(df, "_part", "_place", "_before")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns(
        {part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(2**33 - 1)}
    )
    ranged = stored(ranged, "numbered")
    sizes = ranged.groupBy(part).agg(F.count("*").alias(before))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    joined = ranged.join(F.broadcast(sizes), part)
    return joined.withColumn(place, F.col(place) + F.col(before)).select(
        *map(quoted, df.columns), F.col(place).alias(name)
    )


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished work now.

    It does so when the driver's garbage is collected, which may be long after a large
    intermediate result was written and its shuffles became useless. What the first collection
    lets go of holds the shuffles, which the second one then finds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def map_rows(df: DataFrame, run: Callable, *added: T.StructField) -> DataFrame:
    """``df`` mapped by ``run``, which takes the last column away and gives the ``added`` ones instead.

    Columns are numbered meanwhile, since names with dots don't pass through ``mapInArrow``.
    """
    plain = df.toDF(*(f"c{place}" for place in range(len(df.columns))))
    schema = T.StructType([*plain.schema.fields[:-1], *added])
    return plain.mapInArrow(run, schema).toDF(*df.columns[:-1], *(field.name for field in added))
