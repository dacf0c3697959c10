import os
import random
from collections import Counter

import pytest
from helpers import LOG, at, rows

from jobtrail.operators import activity_windows, responses_within
from jobtrail.sources import outbox_sink, read_outbox
from jobtrail.streaming import (
    activity_changes,
    latest_counts,
    new_keys,
    responses_within_stream,
    run_to_end,
)


def drop_file(spark, folder, rows_, schema, order):
    """One more file in a folder; ``order`` sets its modification time."""
    known = set(folder.glob("*.parquet"))
    spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(folder))
    (new,) = set(folder.glob("*.parquet")) - known
    os.utime(new, (1_700_000_000 + order, 1_700_000_000 + order))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


KEYS = "page_id bigint, url string, page_key string"


def test_each_new_key_comes_once(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    seen = spark.createDataFrame([("seen",)], "page_key string")
    # Copies of one key are a third of what arrives, in every file, and pages without a key too.
    for part in range(3):
        arrived = [(part * 900 + i, "u", "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(900)]
        arrived += [(9_000 + part, "u", "seen"), (9_100 + part, "u", f"only{part}"), (9_200 + part, None, None)]
        drop_file(spark, inbox, arrived, KEYS, part)

    def run():
        found = new_keys(stream(spark, inbox, KEYS), seen)
        run_to_end(found, outbox_sink(out), str(tmp_path / "checkpoint"))
        return read_outbox(spark, out, f"{KEYS}, batch bigint").collect()

    want = Counter({"hot", "only0", "only1", "only2"} | {f"k{i}" for i in range(50)})
    first = run()
    # Pages without a key are each new, as they are in a batch.
    assert Counter(row.page_key for row in first) == want + Counter({None: 3})
    assert all(row.page_id is not None for row in first)
    # A later run takes up where the first ended.
    drop_file(spark, inbox, [(9_999, "u", "hot"), (10_000, "u", "late"), (10_001, None, None)], KEYS, 4)
    assert Counter(row.page_key for row in run()) == want + Counter({None: 4, "late": 1})


@pytest.fixture(scope="module")
def inbox(spark, tmp_path_factory):
    """A log in three files, oldest first."""
    rng = random.Random(11)
    events = [
        (i, at(7 * i), rng.randint(1, 5), rng.choice(["signup", "view", "purchase"])) for i in range(600)
    ]
    folder = tmp_path_factory.mktemp("log") / "inbox"
    for part in range(3):
        drop_file(spark, folder, events[part * 200 : (part + 1) * 200], LOG, part)
    return folder, spark.createDataFrame(events, LOG)


def test_window_counts_equal_the_batch(spark, inbox, tmp_path):
    folder, events = inbox
    changes = activity_changes(stream(spark, folder, LOG), "1 hour", "10 minutes")
    run_to_end(changes, outbox_sink(str(tmp_path / "out")), str(tmp_path / "checkpoint"), "update")
    schema = "window_start timestamp, status string, n bigint, batch bigint"
    written = read_outbox(spark, str(tmp_path / "out"), schema)
    assert written.select("batch").distinct().count() >= 3
    want = rows(activity_windows(events, "1 hour"), "window_start", "status", "n")
    assert rows(latest_counts(written), "window_start", "status", "n") == want


def test_events_behind_the_watermark_are_left_out(spark, tmp_path):
    folder = tmp_path / "inbox"
    drop_file(spark, folder, [(1, at(0), 1, "a"), (2, at(600), 1, "a")], LOG, 0)
    drop_file(spark, folder, [(3, at(601), 1, "a")], LOG, 1)
    drop_file(spark, folder, [(4, at(1), 1, "a"), (5, at(595), 1, "a")], LOG, 2)
    changes = activity_changes(stream(spark, folder, LOG), "1 hour", "10 minutes")
    run_to_end(changes, outbox_sink(str(tmp_path / "out")), str(tmp_path / "checkpoint"), "update")
    schema = "window_start timestamp, status string, n bigint, batch bigint"
    found = latest_counts(read_outbox(spark, str(tmp_path / "out"), schema))
    assert set(rows(found, "window_start", "n")) == {(at(0), 1), (at(540), 1), (at(600), 2)}


@pytest.mark.parametrize("span", ["1 hour", "90 minutes", "1 day"])
def test_answered_applications_equal_the_batch(spark, inbox, tmp_path, span):
    folder, events = inbox
    sent, answers = (
        stream(spark, folder, LOG).where(f"status = '{status}'") for status in ("signup", "purchase")
    )
    found = responses_within_stream(sent, answers, span, "10 minutes")
    run_to_end(found, outbox_sink(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    schema = "application_id bigint, event_id bigint, sent_at timestamp, batch bigint"
    got = read_outbox(spark, str(tmp_path / "out"), schema)
    want = responses_within(events.where("status = 'signup'"), events.where("status = 'purchase'"), span)
    assert rows(got, "application_id", "event_id", "sent_at") == rows(
        want, "application_id", "event_id", "sent_at"
    )
    assert got.count() > 10
