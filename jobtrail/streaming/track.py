"""Track, as events arrive."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.operators.track import activity_windows, quiet_spells


def with_event_time(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark, which needs a timestamp with a zone; run the session in UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def activity_changes(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts per window and status, given out again whenever they grow (update mode).

    State of windows that lie further back than ``late`` is dropped.
    """
    return activity_windows(with_event_time(events, late), width)


def latest_counts(changes: DataFrame) -> DataFrame:
    """Final counts from all batches of changes: a window's last batch holds its full count."""
    return changes.groupBy("window_start", "status").agg(F.max_by("n", "batch").alias("n"))


def responses_within_stream(
    sent: DataFrame, answers: DataFrame, span: str, late: str
) -> DataFrame:
    """Each sent application once, as soon as an answer inside ``span`` has come.

    A semi-join gives no pairs. Both sides are also keyed by a stretch of time as long as the
    span, so the state of a busy application lies in many places; an answer can only belong to
    its own stretch or to the one before, and is put in both.
    """
    ts = F.col("ts")
    sent = with_event_time(sent, late).select(
        "application_id", "event_id", ts.alias("sent_at"), F.window("ts", span).start.alias("stretch")
    )
    own = F.window("ts", span).start
    answers = with_event_time(answers, late).select(
        F.col("application_id").alias("answer_to"), ts.alias("answered_at"), own.alias("own")
    )
    before = F.col("own") - F.expr(f"INTERVAL {span}")
    answers = answers.select(
        "answer_to", "answered_at", F.explode(F.array(F.col("own"), before)).alias("answer_stretch")
    )
    inside = F.expr(f"answered_at BETWEEN sent_at AND sent_at + INTERVAL {span}")
    same = (F.col("application_id") == F.col("answer_to")) & (
        F.col("stretch") == F.col("answer_stretch")
    )
    return sent.join(answers, same & inside, "left_semi").drop("stretch")


def quiet_spells_stream(events: DataFrame, span: str, late: str) -> DataFrame:
    """``quiet_spells`` as they are over (append mode): an application is reported when the watermark, ``late``
    behind the newest event, has passed the end of its span.

    The state holds one window per application and open stretch, and lets go of it with the report.
    """
    return quiet_spells(with_event_time(events, late), span)
