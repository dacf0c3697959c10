"""Running a stream over all files that are there, then stopping."""

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_to_end(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process every file that has arrived, handing each micro-batch to ``sink``.

    A run that was broken off goes on from ``checkpoint`` and hands over its last batch again;
    the sinks of this package then write it in place of itself.
    """
    query = (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
