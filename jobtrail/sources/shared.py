"""The folder all machines of the cluster share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one the session names.

    Only a session that runs on a single machine may do without: it gets a temporary folder.
    """
    root = spark.conf.get(SHARED_FOLDER, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {SHARED_FOLDER} to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="jobtrail-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For a result that is used more than once. It is worked out once, and the loss of an
    executor later on does not make it start again.
    """
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, purpose: str, column: str) -> DataFrame:
    """``stored`` with a folder per value of ``column``, so that a join on it reads the values it needs."""
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.partitionBy(column).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
