import hashlib
import json

import pytest
from helpers import rows

from jobtrail.operators import application_payload, apply_queue, current_status, sent_events
from jobtrail.sources import append_log, outbox_sink, read_log, read_outbox, replaced, write_batch, write_outbox

TOP = "profile_id bigint, role_id bigint, source string"
PAYLOADS = "profile_id bigint, role_id bigint, channel string, payload string"
STORED = PAYLOADS + ", batch bigint"


@pytest.fixture(scope="module")
def top(spark):
    return spark.createDataFrame(
        [(1, 10, "a"), (1, 11, "b"), (2, 10, "a"), (2, 12, None), (2, 13, "unknown")], TOP
    )


@pytest.fixture(scope="module")
def channels(spark):
    return spark.createDataFrame([("a", "email"), ("b", "form"), ("c", "email")], "source string, channel string")


def test_queue_by_role(spark, top, channels):
    applied = spark.createDataFrame([(11,), (11,), (99,)], "role_id bigint")
    found = apply_queue(top, applied, channels)
    assert rows(found, "profile_id", "role_id", "channel") == [
        (1, 10, "email"), (2, 10, "email"), (2, 12, "form"), (2, 13, "form"),
    ]


def test_queue_by_profile_and_role(spark, top, channels):
    applied = spark.createDataFrame([(1, 10), (2, 11)], "profile_id bigint, role_id bigint")
    found = apply_queue(top, applied, channels)
    assert rows(found, "profile_id", "role_id") == [(1, 11), (2, 10), (2, 12), (2, 13)]


def test_one_application_per_role(spark, top):
    """A source with several channels is applied to by the first in alphabetical order."""
    channels = spark.createDataFrame([("a", "form"), ("a", "email"), ("b", None)], "source string, channel string")
    found = apply_queue(top, spark.createDataFrame([], "role_id bigint"), channels)
    told = {int(hashlib.md5(f"{a}-{b}".encode()).hexdigest()[:15], 16): (a, b) for a, b in [(1, 10), (1, 11), (2, 10), (2, 12), (2, 13)]}
    got = {told[row.application_id]: row.channel for row in found.collect()}
    assert got == {(1, 10): "email", (1, 11): "form", (2, 10): "email", (2, 12): "form", (2, 13): "form"}
    assert dict(found.dtypes)["application_id"] == "bigint"


def test_closed_roles_leave_the_queue(spark, top, channels):
    none = spark.createDataFrame([], "role_id bigint")
    found = apply_queue(top, none, channels, closed=spark.createDataFrame([(10,), (10,), (77,)], "role_id bigint"))
    assert rows(found, "profile_id", "role_id") == [(1, 11), (2, 12), (2, 13)]


def test_queue_when_nothing_was_sent(spark, top, channels):
    assert apply_queue(top, spark.createDataFrame([], "role_id bigint"), channels).count() == 5


def test_payloads(spark):
    queue = spark.createDataFrame(
        [(110, 1, 10, "email"), (111, 1, 11, "form"), (112, 1, 12, "form")],
        "application_id bigint, profile_id bigint, role_id bigint, channel string",
    )
    text = 'Said "yes"\nand \\ é\ttab'
    resumes = spark.createDataFrame([(10, text), (11, text)], "role_id bigint, resume string")
    found = application_payload(queue, resumes, {"name": 'A "B"', "phone": "0"})
    payloads = {row.role_id: json.loads(row.payload) for row in found.collect()}
    assert payloads == {
        10: {"subject": "Application for role 10", "body": text},
        11: {"role_id": 11, "name": 'A "B"', "phone": "0", "resume": text},
        12: {"role_id": 12, "name": 'A "B"', "phone": "0", "resume": ""},
    }


def batch(spark, *roles):
    return spark.createDataFrame([(1, role, "form", "{}") for role in roles], PAYLOADS)


def test_batch_written_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "outbox")
    write_outbox(batch(spark, 1, 2, 3), out, 0)
    write_outbox(batch(spark, 4), out, 1)
    write_outbox(batch(spark, 1, 2, 3), out, 0)
    found = rows(read_outbox(spark, out, STORED), "batch", "role_id")
    assert found == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_broken_batch_leaves_the_old_one(spark, tmp_path):
    out = str(tmp_path / "outbox")
    write_outbox(batch(spark, 1, 2), out, 0)

    def lost_halfway(folder):
        batch(spark, 7, 8).write.parquet(folder)
        raise RuntimeError("lost after writing, before the commit")

    with pytest.raises(RuntimeError):
        write_batch(out, 0, spark, lost_halfway)
    assert rows(read_outbox(spark, out, STORED), "batch", "role_id") == [(0, 1), (0, 2)]
    # A reader that looked before the batch was replaced still finds what it saw.
    before = read_outbox(spark, out, STORED)
    write_outbox(batch(spark, 9), out, 0)
    assert rows(before, "role_id") == [(1,), (2,)]
    assert rows(read_outbox(spark, out, STORED), "batch", "role_id") == [(0, 9)]
    assert len(replaced(spark, out)) == 1 and "batch=0/write=" in replaced(spark, out)[0]


def test_no_batches_are_an_empty_table(spark, tmp_path):
    found = read_outbox(spark, str(tmp_path / "none"), STORED)
    assert found.count() == 0 and "batch" in found.columns


def test_outbox_meets_the_log(spark, tmp_path):
    outbox = spark.createDataFrame([(5, 1, 10), (5, 1, 10), (6, 1, 11)], "application_id bigint, profile_id bigint, role_id bigint")
    log = str(tmp_path / "log")
    append_log(sent_events(outbox, "2024-02-01 00:00:00"), log)
    status = current_status(read_log(spark, log))
    assert rows(status, "application_id", "status", "n_events") == [(5, "sent", 1), (6, "sent", 1)]


def test_stream_that_fails_in_the_sink_goes_on_without_loss_or_copies(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "outbox")
    for first in (0, 10, 20):
        batch(spark, *range(first, first + 10)).coalesce(1).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    write = outbox_sink(out)

    def broken(payloads, number):
        write(payloads, number)
        if number == 1:
            raise RuntimeError("lost after writing, before the batch was committed")

    def run(sink):
        query = (
            stream.writeStream.foreachBatch(sink)
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    with pytest.raises(Exception, match="lost after writing"):
        run(broken)
    run(write)
    found = read_outbox(spark, out, STORED)
    assert rows(found, "role_id") == sorted([(role,) for role in range(30)], key=str)
    assert found.select("batch").distinct().count() == 3
