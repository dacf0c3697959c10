"""Apply: queue applications that were not sent yet and write out what would be sent."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CHANNEL = "form"


def apply_queue(
    top: DataFrame, applied: DataFrame, channels: DataFrame, closed: DataFrame | None = None
) -> DataFrame:
    """Chosen roles with no application yet, each with its channel and an id of its application.

    ``applied`` is keyed by role, or by profile and role where it has both columns. Roles in
    ``closed`` (role_id), whose pages are gone, are left out. A source with several channels is
    applied to by the first in alphabetical order, one without by form.
    """
    keys = [name for name in ("profile_id", "role_id") if name in applied.columns]
    open_roles = top.join(applied.select(*keys).distinct(), keys, "left_anti")
    if closed is not None:
        open_roles = open_roles.join(closed.select("role_id").distinct(), "role_id", "left_anti")
    one = channels.groupBy("source").agg(F.min("channel").alias("channel"))
    routed = open_roles.join(one, "source", "left").na.fill(DEFAULT_CHANNEL, ["channel"])
    return routed.withColumn("application_id", application_id("profile_id", "role_id"))


def application_id(profile_id: str, role_id: str) -> Column:
    """The id under which an application is logged, a number as in the log: the same whenever it is worked out.

    60 bits of a digest, so that among a hundred million applications two meet with a chance of one in two hundred.
    """
    told = F.concat_ws("-", F.col(profile_id).cast("string"), F.col(role_id).cast("string"))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("bigint")


def sent_events(outbox: DataFrame, ts: str) -> DataFrame:
    """One event of status ``sent`` for each application in the outbox, for the log.

    Its id is that of the application, so an application that stands in the outbox twice is one event.
    """
    return outbox.select(
        F.col("application_id").alias("event_id"),
        F.lit(ts).cast("timestamp_ntz").alias("ts"),
        "application_id",
        F.lit("sent").alias("status"),
    ).distinct()


def application_payload(queue: DataFrame, resumes: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """One JSON document per application.

    A form application maps each form field to its value. A mail has a subject and a body.
    ``fields`` are the applicant's own answers, the same on every form.
    """
    text = F.coalesce("resume", F.lit(""))
    answers = [F.lit(value).alias(field) for field, value in fields.items()]
    form = F.struct(F.col("role_id"), *answers, text.alias("resume"))
    subject = F.concat(F.lit("Application for role "), F.col("role_id").cast("string"))
    mail = F.struct(subject.alias("subject"), text.alias("body"))
    payload = F.when(F.col("channel") == "email", F.to_json(mail)).otherwise(F.to_json(form))
    return queue.join(resumes, "role_id", "left").select(
        "application_id", "profile_id", "role_id", "channel", payload.alias("payload")
    )
