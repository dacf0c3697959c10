"""Reports from what is stored of each day: days that are over are not read again.

Distinct applications don't add up, since one may come on two days, and quantiles don't either. Sketches of them do, with
an error. The exact reports store the applications of each day, and how long the statuses that began on it lasted.
"""

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.sources.shared import stored

#: Logarithm of the buckets of a HyperLogLog sketch: a relative standard error of 1.6 %. Small counts are exact.
BUCKETS = 12
#: Size of a KLL sketch: up to so many durations it is exact, beyond that ranks are off by 0.1 % or so.
KEPT = 4096
#: Exact quantiles are found digit by digit: the bits below each digit. No digit has more than 2**22 values.
DIGITS = (42, 21, 0)


def application_sketches(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(status, day, n, sketch): events, and a sketch of the applications they belong to. Null applications
    are events, but no application."""
    return events.groupBy("status", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("application_id", buckets).alias("sketch")
    )


def application_report(sketches: DataFrame) -> DataFrame:
    """(level, status, day, n, applications): by status and day, by status, and in all; ``applications`` counts
    each application once per line."""
    level = F.when(F.grouping("status") == 1, "total").when(F.grouping("day") == 1, "status")
    return (
        sketches.rollup("status", "day")
        .agg(
            F.sum("n").alias("n"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("applications"),
            level.otherwise("day").alias("level"),
        )
        .select("level", "status", "day", "n", "applications")
    )


def duration_sketches(history: DataFrame, kept: int = KEPT) -> DataFrame:
    """(status, day, n, sketch) of ``status_history``: how long the statuses that began on a day lasted. Statuses
    that still last are not in it."""
    ended = history.where("lasted_us IS NOT NULL")
    return ended.groupBy("status", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_bigint("lasted_us", kept).alias("sketch")
    )


def duration_quantiles(
    sketches: DataFrame, quantiles: Mapping[str, float], first: str | None = None, last: str | None = None, kept: int = KEPT
) -> DataFrame:
    """(status, n, one column for each of ``quantiles``) over the days from ``first`` to ``last``."""
    chosen = sketches
    if first is not None:
        chosen = chosen.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        chosen = chosen.where(F.col("day") <= F.lit(last).cast("date"))
    merged = chosen.groupBy("status").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", kept).alias("sketch"))
    columns = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(share)).alias(name) for name, share in quantiles.items()]
    return merged.select("status", "n", *columns)


def daily_applications(events: DataFrame) -> DataFrame:
    """(status, day, application_id, n): the applications of each day, with how many events they had."""
    return events.groupBy("status", F.to_date("ts").alias("day"), "application_id").agg(F.count("*").alias("n"))


def exact_report(daily: DataFrame) -> DataFrame:
    """What ``application_report`` gives, counted from ``daily_applications`` without an error."""
    level = F.when(F.grouping("status") == 1, "total").when(F.grouping("day") == 1, "status")
    return (
        daily.rollup("status", "day")
        .agg(
            F.sum("n").alias("n"),
            F.count_distinct("application_id").alias("applications"),
            level.otherwise("day").alias("level"),
        )
        .select("level", "status", "day", "n", "applications")
    )


def daily_durations(history: DataFrame) -> DataFrame:
    """(status, day, lasted_us) of ``status_history``: each status that ended, with the day it began on."""
    return history.where("lasted_us IS NOT NULL").select("status", F.to_date("ts").alias("day"), "lasted_us")


def exact_quantiles(daily: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """(status, n, one column for each of ``quantiles``): the smallest duration that at least that share does not exceed.

    ``daily`` is stored and read once per digit of a duration. Each time the durations that begin with the digits found
    so far are counted by their next one, and running counts tell which it is. No task holds the durations of a status.
    """
    sizes = stored(daily.groupBy("status").agg(F.count("*").alias("n")), "duration-counts")
    ranks = [
        F.struct(
            F.lit(name).alias("name"),
            F.greatest(F.lit(1), F.ceil(F.col("n").cast("decimal(18,0)") * F.lit(Decimal(str(share))))).cast("bigint").alias("rank"),
        )
        for name, share in quantiles.items()
    ]
    if not ranks:
        return sizes
    # Nothing is known of a duration at first: all have the same start.
    sought = sizes.select("status", F.inline(F.array(*ranks)), F.lit(0).cast("bigint").alias("start"))
    before = None
    for below in DIGITS:
        start = F.lit(0).cast("bigint") if before is None else F.shiftright("lasted_us", before)
        found = daily.select("status", start.alias("start"), F.shiftright("lasted_us", below).alias("next"))
        if before is not None:
            found = _begun(found, sought)
        found = found.groupBy("status", "start", "next").agg(F.count("*").alias("here"))
        up_to = F.sum("here").over(Window.partitionBy("status", "start").orderBy("next"))
        found = found.withColumn("up_to", up_to).withColumnsRenamed({"status": "_status", "start": "_start"})
        met = F.col("status").eqNullSafe(F.col("_status")) & (F.col("start") == F.col("_start"))
        inside = (F.col("rank") <= F.col("up_to")) & (F.col("rank") > F.col("up_to") - F.col("here"))
        left = F.col("rank") - (F.col("up_to") - F.col("here"))
        sought = sought.join(found, met & inside).select("status", "name", left.alias("rank"), F.col("next").alias("start"))
        sought = stored(sought, "duration-digits")
        before = below
    columns = [F.max(F.when(F.col("name") == name, F.col("start"))).alias(name) for name in quantiles]
    found = sought.groupBy("status").agg(*columns).withColumnRenamed("status", "_status")
    return sizes.join(found, F.col("status").eqNullSafe(F.col("_status"))).select("status", "n", *quantiles)


def _begun(found: DataFrame, sought: DataFrame) -> DataFrame:
    """Rows of ``found`` of a status and start that are ``sought``; a null status is one like others."""
    starts = sought.select(F.col("status").alias("_status"), F.col("start").alias("_start")).distinct()
    met = F.col("status").eqNullSafe(F.col("_status")) & (F.col("start") == F.col("_start"))
    return found.join(starts, met, "left_semi")
