"""Input tables, read with explicit schemas."""

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}


#: Tables up to this size are dealt over all cores.
SMALL = 256 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _bytes(df: DataFrame) -> int:
    """What Spark estimates ``df`` to take, by its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, key: str, each: int) -> DataFrame:
    """A stored table, dealt by ``key`` to as many tasks as it has ``each`` bytes, or cores if those are more.

    For work that makes many rows of one and groups them by ``key``: these stay in the task, and a task has no more
    of them the larger the table is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-_bytes(df) // each)), key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table of at most ``SMALL`` bytes, as its files are, over all cores.

    For work that is heavy per row, such as reading texts. Larger tables are never moved: they
    are read in many tasks anyway.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if _bytes(df) <= SMALL else df


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The same table as a stream of arriving files.

    The path is a pattern, which matches a table that is one file as well as a folder of files.
    """
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}[.]parquet")


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl's pages. Columns that are not used downstream are not read."""
    return read_table(spark, folder, "pages")
