"""The tracking log: Parquet, one folder per day."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.sources.commits import read_batches, write_batch

LOG_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, application_id bigint, status string, "
    "value double, props string, day date"
)


def append_log(events: DataFrame, folder: str, batch: int = 0) -> None:
    """Write one batch of events to the log. Writing the same batch again replaces it, all at once.

    Rebalancing brings the rows of a day together in files of the advised size: a quiet day is
    one file, and a day with very many events is split over many tasks.
    """
    dated = events.withColumn("day", F.to_date("ts")).hint("rebalance", "day")
    write_batch(folder, batch, events.sparkSession, lambda out: dated.write.partitionBy("day").parquet(out))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All batches of the log. Filters on ``day`` skip whole folders."""
    return read_batches(spark, folder, LOG_SCHEMA)
