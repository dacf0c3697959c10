"""Apply queries."""

from pyspark.sql import DataFrame, SparkSession

from jobtrail.operators import (
    application_payload,
    apply_queue,
    assemble_resume,
    current_status,
    rank_fragments,
    sent_events,
    snapshot_diff,
    top_roles,
)
from jobtrail.plans import inputs
from jobtrail.plans import score as score_plans
from jobtrail.plans import tailor as tailor_plans
from jobtrail.sources import append_log, new_folder, read_log, read_outbox, scan_pages, stored, write_outbox

# Roles to apply for, per search.
K = 100

OUTBOX_SCHEMA = "application_id bigint, profile_id string, role_id bigint, channel string, payload string, batch bigint"

# When the outbox is sent off.
SENT_AT = "2024-02-01 00:00:00"

# The applicant's answers to form fields.
FIELDS = {"name": "A. Applicant", "phone": "000", "start": "at once"}


def chosen(spark: SparkSession, folder: str) -> DataFrame:
    """The best roles of each search, with the source each came from."""
    top = top_roles(score_plans.by_keywords(spark, folder), K)
    sources = inputs.roles(spark, folder).select("role_id", "source")
    return top.select("profile_id", "role_id").join(sources, "role_id")


def closed(spark: SparkSession, folder: str) -> DataFrame:
    """Roles whose pages are gone."""
    now = inputs.current_pages(scan_pages(spark, folder))
    gone = snapshot_diff(inputs.previous_pages(spark, folder), now).where("state = 'removed'")
    return gone.selectExpr("page_id AS role_id")


def queue(spark: SparkSession, folder: str) -> DataFrame:
    return apply_queue(
        chosen(spark, folder), inputs.applied(spark, folder), inputs.channels(spark), closed(spark, folder)
    ).select("application_id", "profile_id", "role_id", "source", "channel")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Resumes are tailored to the queued roles only, which are few but may be long."""
    queued = stored(queue(spark, folder), "queue")
    ids = stored(queued.select("role_id").distinct(), "queued-roles")
    roles = inputs.roles(spark, folder).join(ids, "role_id", "left_semi")
    fragments = inputs.fragments(spark, folder)
    ranked = rank_fragments(roles, fragments, tailor_plans.K)
    return application_payload(queued, assemble_resume(roles, ranked, fragments), FIELDS)


def outbox(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "outbox")
    write_outbox(payloads(spark, folder), out, batch=0)
    return read_outbox(spark, out, OUTBOX_SCHEMA)


def followed(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the applications in the outbox: they are logged as sent, and the log is asked for them."""
    sent = stored(outbox(spark, folder).drop("batch"), "sent")
    log = new_folder(spark, "log")
    append_log(inputs.log(spark, folder), log)
    append_log(sent_events(sent, SENT_AT), log, batch=1)
    status = current_status(read_log(spark, log))
    found = sent.join(status, "application_id", "left")
    return found.select("application_id", "profile_id", "role_id", "channel", "status", "n_events")


QUERIES = {
    "apply_queue": queue,
    "application_payload": payloads,
    "write_outbox": outbox,
    "sent_applications": followed,
}

_QUEUE = f"""{score_plans.WANTED},
    chosen AS ({score_plans.TOP.format(scores="kw", k=K)}),
    queue AS (SELECT CAST('0x' || substr(md5(profile_id || '-' || role_id), 1, 15) AS BIGINT) AS application_id, profile_id, role_id, source,
                     CASE WHEN source IN ('src1', 'src2') THEN 'email' ELSE 'form' END AS channel
              FROM chosen JOIN documents ON doc_id = role_id
              WHERE role_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')
                AND role_id NOT IN (SELECT page_id FROM pages
                                    WHERE ends_with(url, '#top') AND NOT ends_with(url, '?utm_source=feed')))"""

_PAYLOADS = f"""{_QUEUE}, {tailor_plans.RESUMES},
    payloads AS (
        SELECT application_id, profile_id, role_id, channel,
               CAST(CASE WHEN channel = 'email'
                    THEN json_object('subject', 'Application for role ' || role_id, 'body', resume)
                    ELSE json_object('role_id', role_id, 'name', 'A. Applicant', 'phone', '000',
                                     'start', 'at once', 'resume', resume) END AS VARCHAR) AS payload
        FROM queue JOIN resumes USING (role_id))"""

ORACLES = {
    "apply_queue": f"WITH {_QUEUE} SELECT application_id, profile_id, role_id, source, channel FROM queue",
    "application_payload": f"WITH {_PAYLOADS} SELECT application_id, profile_id, role_id, channel, payload FROM payloads",
    "write_outbox": f"""WITH {_PAYLOADS}
        SELECT application_id, profile_id, role_id, channel, payload, CAST(0 AS BIGINT) AS batch FROM payloads""",
    "sent_applications": f"""WITH {_QUEUE}
        SELECT application_id, profile_id, role_id, channel, 'sent' AS status,
               1 + (SELECT count(*) FROM events WHERE user_id = application_id) AS n_events
        FROM queue""",
}
