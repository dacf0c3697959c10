"""The outbox: application payloads, one folder per batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobtrail.sources.commits import read_batches, write_batch


def write_outbox(payloads: DataFrame, folder: str, batch: int) -> None:
    """Write one batch. Writing the same batch again replaces it, all at once."""
    rows = payloads.hint("rebalance")
    write_batch(folder, batch, payloads.sparkSession, lambda out: rows.write.parquet(out))


def outbox_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: a batch that is run again after a failure replaces itself."""

    def write(payloads: DataFrame, batch: int) -> None:
        write_outbox(payloads, folder, batch)

    return write


def read_outbox(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches. ``schema`` ends in ``batch bigint``, the batch a row was written in."""
    return read_batches(spark, folder, schema)
