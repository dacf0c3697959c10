"""Column expressions over times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    seconds = (ts - F.expr(EPOCH)).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")
