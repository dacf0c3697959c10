"""Track: what happened to each application.

Events have ``event_id, ts, application_id, status``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions.times import EPOCH, micros

#: Time that the events of an application are sorted together for.
STRETCH = "1 day"


def _length(span: str) -> Column:
    """Microseconds of a span of days, hours, minutes or seconds."""
    return micros(F.expr(f"{EPOCH} + INTERVAL {span}"))


def current_status(events: DataFrame) -> DataFrame:
    """Last status, its time and the number of events, per application.

    Events of the same moment are ordered by id. Each task folds its own events of an
    application to one row before the shuffle, so a busy application is no burden.
    """
    last = F.max(F.struct("ts", "event_id", "status")).alias("last")
    return (
        events.groupBy("application_id")
        .agg(last, F.count("*").alias("n_events"))
        .select(
            "application_id",
            F.col("last.status").alias("status"),
            F.col("last.ts").alias("last_ts"),
            "n_events",
        )
    )


def status_history(events: DataFrame, stretch: str = STRETCH) -> DataFrame:
    """Each event with the microseconds until the application's next event; null for the last.

    Events of a moment are ordered by id, then status. An event without a time is last and has no
    length; events without an application, or without an id, are ordered like others, nulls last.

    Events are sorted by application and ``stretch`` of time, so a busy application lies in many
    tasks. The last event of a stretch is followed by the first of a later one, which is
    looked up among one row per application and stretch. The stretch does not change the answer.
    """
    app, at = F.col("application_id"), F.col("ts")
    part = F.floor(micros(at) / _length(stretch))
    log = events.select("application_id", "event_id", "status", "ts").withColumns(
        # Without nulls, so that the window and the join share one layout.
        {
            "_app": F.coalesce(app, F.lit(0)),
            "_no_app": app.isNull(),
            "_part": F.coalesce(part, F.lit(0)),
            "_no_part": part.isNull(),
        }
    )
    keys = ["_app", "_no_app", "_part", "_no_part"]
    order = [F.col(name).asc_nulls_last() for name in ("ts", "event_id", "status")]
    log = log.withColumn("next_ts", F.lead("ts").over(Window.partitionBy(*keys).orderBy(*order)))
    along = Window.partitionBy("_app", "_no_app").orderBy("_no_part", "_part")
    firsts = log.groupBy(*keys).agg(F.min("ts").alias("first_ts"))
    later = firsts.withColumn("later_ts", F.lead("first_ts").over(along)).drop("first_ts")
    lasted = micros(F.coalesce("next_ts", "later_ts")) - micros(at)
    return log.join(later, keys).select(
        "application_id", "event_id", "status", "ts", F.when(at.isNotNull(), lasted).alias("lasted_us")
    )


def stage_funnel(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per application, how often and when first each stage was reached."""
    reached = []
    for stage in stages:
        at_stage = F.col("status") == stage
        reached.append(F.count(F.when(at_stage, 1)).alias(f"n_{stage}"))
        reached.append(F.min(F.when(at_stage, F.col("ts"))).alias(f"first_{stage}"))
    return events.groupBy("application_id").agg(*reached)


def status_report(events: DataFrame) -> DataFrame:
    """Event counts by status and day, with a subtotal per status and a grand total.

    The rollup triples its input, so it is given one row per status and day, not the events.
    """
    per_day = events.groupBy("status", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    level = F.when(F.grouping("status") == 1, "total").when(F.grouping("day") == 1, "status")
    return (
        per_day.rollup("status", "day")
        .agg(F.sum("n").alias("n"), level.otherwise("day").alias("level"))
        .select("level", "status", "day", "n")
    )


def activity_windows(events: DataFrame, width: str) -> DataFrame:
    """Event counts by status in windows of ``width`` that do not overlap; batch or stream."""
    return (
        events.groupBy(F.window("ts", width), "status")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "status", "n")
    )


def stale_applications(events: DataFrame, cutoff: str) -> DataFrame:
    """Applications with no event at or after ``cutoff``."""
    return (
        events.groupBy("application_id")
        .agg(F.max("ts").alias("last_ts"))
        .where(F.col("last_ts") < F.lit(cutoff).cast("timestamp_ntz"))
    )


def responses_within(sent: DataFrame, answers: DataFrame, span: str) -> DataFrame:
    """Each sent application answered within ``span``: how many answers, and the first.

    An event that was logged twice is one sent application. Events without an application or
    a time answer nothing and are not answered. Both ends of the span count.

    No (sent, answer) pair is formed. Time is cut in stretches as long as the span, so that each
    span ends in its own stretch or in the next. Both ends are marked among the answers of the
    application in their stretch. Going back in time, running counts give the answers from the
    start to the end of its stretch, and those behind the end. A busy application lies in many tasks.
    """
    known = F.col("application_id").isNotNull() & F.col("ts").isNotNull()
    sent = sent.where(known).select("application_id", "event_id", F.col("ts").alias("sent_at")).distinct()
    sent = sent.withColumn("until", F.col("sent_at") + F.expr(f"INTERVAL {span}"))
    starts, replies, ends = 0, 1, 2
    part = F.floor(micros(F.col("at")) / _length(span))
    both_ends = F.array(
        F.struct(F.col("sent_at").alias("at"), F.lit(starts).alias("mark")),
        F.struct(F.col("until").alias("at"), F.lit(ends).alias("mark")),
    )
    marks = sent.select("application_id", "event_id", "sent_at", "until", F.inline(both_ends))
    answered = answers.where(known).select(
        "application_id", F.col("ts").alias("at"), F.lit(replies).alias("mark")
    )
    marks = marks.unionByName(answered, allowMissingColumns=True).withColumn("part", part)

    stretch = Window.partitionBy("application_id", "part")
    # At one moment the end comes first, then answers, then the start: all of them count.
    back = stretch.orderBy(F.col("at").desc(), F.col("mark").desc())
    back = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reply = F.when(F.col("mark") == replies, F.col("at"))
    marks = marks.withColumns(
        {
            "behind": F.count(reply).over(back),
            "all": F.count(reply).over(stretch),
            "next": F.min(reply).over(back),
            "first": F.min(reply).over(stretch),
        }
    )
    at_start = F.col("mark") == starts
    crosses = F.floor(micros(F.col("sent_at")) / _length(span)) != F.col("part")
    up_to_end = F.when(crosses, F.col("all")).otherwise(0) - F.col("behind")
    in_next = F.when(crosses & (F.col("first") <= F.col("until")), F.col("first"))
    return (
        marks.where(F.col("mark") != replies)
        .groupBy("application_id", "event_id", "sent_at")
        .agg(
            F.sum(F.when(at_start, F.col("behind")).otherwise(up_to_end)).alias("n_answers"),
            F.min(F.when(at_start, F.col("next")).otherwise(in_next)).alias("first_answer"),
        )
        .where("n_answers > 0")
    )


def quiet_spells(events: DataFrame, span: str) -> DataFrame:
    """(application_id, last_ts, quiet_at, n_events) of each stretch of an application's events after which
    nothing came for longer than ``span``; batch or stream. ``last_ts`` is the last event, ``quiet_at`` when the span was over.

    Windows that grow with each event close ``span`` after the last one. In a batch each application's last stretch
    is closed too, whenever it was. Events without a time are left out; a null application is one like others.
    """
    window = F.session_window("ts", span)
    return (
        events.groupBy("application_id", window)
        .agg(F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))
        .select("application_id", "last_ts", F.col("session_window.end").alias("quiet_at"), "n_events")
    )


def response_pairs(sent: DataFrame, answers: DataFrame, span: str, cut: int = 4) -> DataFrame:
    """(application_id, event_id, sent_at, answer_id, answered_at): each answer within ``span`` of each sending of
    its application; both ends of the span count.

    Events logged twice, and those without an application or a time, count as in ``responses_within``.
    Time is cut in stretches of a part of the span, ``cut`` to one. A sending stays in its stretch and
    an answer goes to its own and the ``cut`` before, where all sendings it can belong to are. So both sides meet by
    application and stretch, and a busy application lies in as many tasks as it has stretches.
    """
    known = F.col("application_id").isNotNull() & F.col("ts").isNotNull()
    part = F.floor(micros(F.col("ts")) * cut / _length(span))
    left = sent.where(known).select("application_id", "event_id", F.col("ts").alias("sent_at"), part.alias("part")).distinct()
    right = answers.where(known).select(
        "application_id", F.col("event_id").alias("answer_id"), F.col("ts").alias("answered_at"),
        F.explode(F.sequence(part - cut, part)).alias("part"),
    ).distinct()
    inside = F.expr(f"answered_at BETWEEN sent_at AND sent_at + INTERVAL {span}")
    return left.join(right, ["application_id", "part"]).where(inside).drop("part")
