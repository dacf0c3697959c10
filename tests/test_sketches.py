"""Seen keys, distinct applications and durations from sketches; quiet spells; pairs; pages without the site's lines."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from helpers import LOG, T0, at, rows
from pyspark.sql import functions as F

from jobtrail.operators import (
    application_report,
    application_sketches,
    duration_quantiles,
    duration_sketches,
    marked_keys,
    merged_sketch,
    new_by_sketch,
    new_roles,
    own_content,
    quiet_spells,
    response_pairs,
    responses_within,
    seen_sketch,
    snapshot_diff,
    status_history,
)
from jobtrail.sources import outbox_sink, read_outbox
from jobtrail.streaming import quiet_spells_stream, run_to_end
from test_streams import drop_file, stream

KEYS = "page_id bigint, page_key string"


# --- seen keys ---


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_new_by_sketch_equals_new_roles(spark, bits):
    rng = random.Random(2)
    # With few bits, most new keys share a bit with a seen one and must be looked up.
    seen = [(i, f"seen{rng.randrange(40_000)}") for i in range(30_000)] + [(1, None)]
    found = [(i, f"new{i % 2000}") for i in range(2500)] + [(9000 + i, f"seen{i}") for i in range(2000)] + [(9999, None), (9998, None)]
    roles, old = spark.createDataFrame(found, KEYS), spark.createDataFrame(seen, KEYS)
    parts = [seen_sketch(old.where(F.pmod("page_id", F.lit(3)) == part), bits=bits) for part in range(3)]
    sketch = merged_sketch(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert rows(sketch, "slot", "marks") == rows(seen_sketch(old, bits=bits), "slot", "marks")
    assert sketch.count() <= bits >> 15
    got = new_by_sketch(roles, old, sketch, bits=bits)
    assert rows(got, "page_id", "page_key") == rows(new_roles(roles, old), "page_id", "page_key")
    told = marked_keys(roles, sketch, bits=bits)
    # No seen key is ever told to be new.
    assert told.where("NOT marked").join(old, "page_key", "left_semi").count() == 0
    if bits > 1 << 15:
        assert told.where("marked AND page_key LIKE 'new%'").count() < 200


def test_shuffle_of_new_by_sketch_does_not_grow_with_what_was_seen(spark):
    roles = spark.range(300).selectExpr("id AS page_id", "concat('k', id * 7) AS page_key")

    def shuffled(n):
        old = spark.range(n).selectExpr("id AS page_id", "concat('k', id) AS page_key")
        sketch = seen_sketch(old)
        found = marked_keys(old.select("page_key"), seen_sketch(marked_keys(roles, sketch).where("marked")), "page_key")
        return found.where("marked").count()

    # Seen keys that pass the filter, which are all that the look-up shuffles.
    assert shuffled(2_000) < shuffled(200_000) <= 300 * 1.2


def test_sketch_of_nothing(spark):
    none, one = spark.createDataFrame([], KEYS), spark.createDataFrame([(1, "a"), (2, None)], KEYS)
    assert rows(new_by_sketch(one, none, seen_sketch(none)), "page_id") == [(1,), (2,)]
    assert new_by_sketch(none, one, seen_sketch(one)).count() == 0


# --- reports ---


def log(spark, rng, n, applications):
    events = [
        (i, at(rng.randrange(9 * 1440)), rng.choice((None, *range(applications))) if i % 9 == 0 else rng.randrange(applications), rng.choice("ab"))
        for i in range(n)
    ]
    return events, spark.createDataFrame(events, LOG)


def test_distinct_applications(spark):
    events, df = log(spark, random.Random(3), 3000, 120)
    got = {(row.level, row.status, row.day): (row.n, row.applications) for row in application_report(application_sketches(df)).collect()}
    want = defaultdict(lambda: [0, set()])
    for _, ts, app, status in events:
        for line in (("day", status, ts.date()), ("status", status, None), ("total", None, None)):
            want[line][0] += 1
            want[line][1].add(app)
    assert got == {line: (n, len(apps - {None})) for line, (n, apps) in want.items()}


def test_many_distinct_applications_within_the_error(spark):
    df = spark.range(400_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 5 AS INT)) AS ts", "id % 90000 AS application_id", "'a' AS status"
    )
    days = application_sketches(df)
    found = {row.level: row.applications for row in application_report(days).collect()}
    assert abs(found["total"] - 90_000) < 3 * 0.016 * 90_000
    # Sums of days would count every application several times.
    assert days.count() == 5 and found["total"] == found["status"]


def test_duration_quantiles(spark):
    rng = random.Random(4)
    _, df = log(spark, rng, 4000, 30)
    history = status_history(df)
    sketches = duration_sketches(history)
    lasted = defaultdict(list)
    for row in history.collect():
        if row.lasted_us is not None:
            lasted[row.status].append((row.ts.date(), row.lasted_us))
    quantiles = {"least": 0.0, "half": 0.5, "most": 0.9, "all": 1.0}
    got = {row.status: row for row in duration_quantiles(sketches, quantiles).collect()}
    for status, found in lasted.items():
        us = sorted(us for _, us in found)
        want = [us[max(0, -(-int(share * 1000 * len(us)) // 1000) - 1)] for share in quantiles.values()]
        assert [got[status][name] for name in quantiles] == want and got[status].n == len(us)
    some = {row.status: row.n for row in duration_quantiles(sketches, {}, "2024-01-03", "2024-01-04").collect()}
    days = [(T0 + timedelta(days=d)).date() for d in (2, 3)]
    assert some == {status: sum(day in days for day, _ in found) for status, found in lasted.items()}


def test_quantiles_beyond_the_kept_size_within_the_error(spark):
    history = spark.range(300_000).selectExpr(
        "'a' AS status", "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 7 AS INT)) AS ts", "(id * 7919) % 300000 AS lasted_us"
    )
    row = duration_quantiles(duration_sketches(history), {"low": 0.1, "half": 0.5, "high": 0.99}).first()
    for value, share in ((row.low, 0.1), (row.half, 0.5), (row.high, 0.99)):
        assert abs(value / 300_000 - share) < 0.003


# --- quiet spells ---


def spells_by_hand(events, span):
    times = defaultdict(list)
    for _, ts, app, _ in events:
        if ts is not None:
            times[app].append(ts)
    found = []
    for app, all_ts in times.items():
        held = []
        for ts in sorted(all_ts):
            if held and ts - held[-1] > span:
                found.append((app, held[-1], held[-1] + span, len(held)))
                held = []
            held.append(ts)
        found.append((app, held[-1], held[-1] + span, len(held)))
    return sorted(found, key=str)


def test_quiet_spells(spark):
    rng = random.Random(6)
    events = [(i, at(rng.randrange(5000)), rng.choice((None, 1, 2, 3)), "a") for i in range(200)] + [(500, None, 1, "a")]
    # Exactly the span apart is not quiet yet.
    events += [(600, at(10_000), 8, "a"), (601, at(10_060), 8, "a"), (602, at(10_121), 8, "a")]
    got = quiet_spells(spark.createDataFrame(events, LOG), "60 minutes")
    assert rows(got, "application_id", "last_ts", "quiet_at", "n_events") == spells_by_hand(events, timedelta(minutes=60))


def test_quiet_spells_as_events_arrive(spark, tmp_path):
    """Three files by time, with events that are late but within the watermark; equal to the batch for all that is over."""
    rng = random.Random(7)
    events = [(i, at(5 * i), rng.choice((None, *range(12))), "a") for i in range(900)]
    files = [events[:300], events[300:600], events[600:]]
    files[1] += [files[0].pop(290), files[0].pop(280)]
    files[2] += [files[1].pop(285)]
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    for order, part in enumerate(files):
        drop_file(spark, inbox, part, LOG, order)
    found = quiet_spells_stream(stream(spark, inbox, LOG), "90 minutes", "5 hours")
    run_to_end(found, outbox_sink(out), str(tmp_path / "checkpoint"))
    schema = "application_id bigint, last_ts timestamp_ntz, quiet_at timestamp_ntz, n_events bigint, batch bigint"
    got = rows(read_outbox(spark, out, schema), "application_id", "last_ts", "quiet_at", "n_events")
    seen = max(ts for _, ts, *_ in events) - timedelta(hours=5)
    want = [spell for spell in spells_by_hand(events, timedelta(minutes=90)) if spell[2] <= seen]
    assert got == want and len(got) > 50


# --- pairs ---


@pytest.mark.parametrize("cut", [1, 4, 7])
def test_response_pairs_by_hand(spark, cut):
    rng = random.Random(8)
    events = [(i, at(rng.randrange(3000)), rng.choice((1, 1, 1, 2, 3, None)), rng.choice(("sent", "answer"))) for i in range(400)]
    events += [(900, at(0), 9, "sent"), (901, at(60), 9, "answer"), (902, at(61), 9, "answer"), (903, at(0), 9, "answer"), (904, None, 9, "answer")]
    df = spark.createDataFrame(events + events[:5], LOG)
    sent, answers = df.where("status = 'sent'"), df.where("status = 'answer'")
    got = response_pairs(sent, answers, "1 hour", cut)
    want = [
        (a, i, ts, j, back)
        for i, ts, a, s in events if s == "sent" and a is not None
        for j, back, b, t in events if t == "answer" and b == a and back is not None and ts <= back <= ts + timedelta(hours=1)
    ]
    assert rows(got, "application_id", "event_id", "sent_at", "answer_id", "answered_at") == sorted(want, key=str)
    counts = got.groupBy("application_id", "event_id", "sent_at").agg(F.min("answered_at").alias("first_answer"))
    counted = responses_within(sent, answers, "1 hour")
    columns = ("application_id", "event_id", "sent_at", "first_answer")
    assert rows(counts, *columns) == rows(counted, *columns)


def test_pairs_of_a_busy_application_lie_in_many_tasks(spark):
    one = spark.range(20_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts", "1L AS application_id")
    pairs = response_pairs(one, one.where("event_id % 40 = 0"), "2 hours", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [row["n"] for row in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


# --- the site's own lines ---

PAGES = "page_id bigint, url string, html string"


def page(number, body, footer="<p>Imprint</p>", host="a.com"):
    return (number, f"https://{host}/{number}", f"<html><nav>Menu<b>Jobs</b></nav><article>{body}</article>{footer}</html>")


def test_a_changed_footer_is_no_changed_role(spark):
    before = [page(i, f"<h1>Role {i}</h1>") for i in range(6)]
    now = [page(i, f"<h1>Role {i}</h1>", "<p>Imprint</p><p>New 2025</p>") for i in range(5)]
    now[2] = page(2, "<h1>Role 2</h1>, now remote", "<p>Imprint</p><p>New 2025</p>")
    # A host with two pages has no lines of a site; null html and addresses are pages too.
    before += [page(10, "x", host="b.com"), page(11, "x", host="b.com"), (20, None, None), (21, "https://c.com/1", None)]
    now += [page(10, "x", host="b.com"), page(11, "x", "<p>y</p>", host="b.com"), (20, None, "<p>z</p>"), (22, "https://c.com/2", "")]
    prev, cur = (own_content(spark.createDataFrame(pages, PAGES)) for pages in (before, now))
    got = dict(rows(snapshot_diff(prev, cur), "page_id", "state"))
    assert got == {
        0: "same", 1: "same", 2: "changed", 3: "same", 4: "same", 5: "removed", 10: "same", 11: "changed",
        20: "changed", 21: "removed", 22: "added",
    }
    plain = dict(rows(snapshot_diff(*(spark.createDataFrame(pages, PAGES) for pages in (before, now))), "page_id", "state"))
    assert [plain[i] for i in range(5)] == ["changed"] * 5


def test_no_pages_have_no_content(spark):
    assert own_content(spark.createDataFrame([], PAGES)).collect() == []
