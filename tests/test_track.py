import random
from datetime import datetime, timedelta

import pytest
from helpers import LOG, at, plan_of, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from jobtrail.operators import (
    activity_windows,
    current_status,
    responses_within,
    stage_funnel,
    stale_applications,
    status_history,
    status_report,
)
from jobtrail.sources import append_log, read_log


def log(spark, *events):
    return spark.createDataFrame(list(events), LOG)


@pytest.fixture(scope="module")
def busy():
    """Application 1 holds most events, and many share a moment."""
    rng = random.Random(5)
    statuses = ["view", "signup", "purchase", "error"]
    events = []
    for i in range(1500):
        app = 1 if rng.random() < 0.7 else rng.randint(2, 9)
        minute = rng.randint(0, 400) if rng.random() < 0.5 else rng.randint(0, 20) * 60
        events.append((i, at(minute), app, rng.choice(statuses)))
    rng.shuffle(events)
    return events


def test_current_status_breaks_ties_by_event(spark):
    found = current_status(
        log(spark, (1, at(0), 1, "a"), (3, at(5), 1, "b"), (2, at(5), 1, "z"), (4, at(1), 2, "c"))
    )
    assert rows(found, "application_id", "status", "last_ts", "n_events") == [
        (1, "b", at(5), 3), (2, "c", at(1), 1),
    ]


def test_current_status_folds_before_the_shuffle(spark):
    plan = plan_of(current_status(log(spark, (1, at(0), 1, "a"))))
    assert "partial_max" in plan.split("Exchange hashpartitioning")[1]


def history_by_hand(events):
    ordered = sorted(events, key=lambda e: (e[2], e[1], e[0]))
    found = []
    for event, following in zip(ordered, ordered[1:] + [(None, None, None, None)]):
        same = following[2] == event[2]
        lasted = (following[1] - event[1]) // timedelta(microseconds=1) if same else None
        found.append((event[2], event[0], lasted))
    return sorted(found, key=str)


def test_history_of_a_single_event(spark):
    found = status_history(log(spark, (1, at(0), 1, "a")))
    assert rows(found, "application_id", "event_id", "lasted_us") == [(1, 1, None)]


@pytest.mark.parametrize("stretch", ["1 minute", "3 hours", "9 days"])
def test_history_by_hand(spark, busy, stretch):
    found = status_history(log(spark, *busy), stretch)
    assert rows(found, "application_id", "event_id", "lasted_us") == history_by_hand(busy)


ODD = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(1, 4)),
        st.one_of(st.none(), st.integers(0, 300)),
        st.one_of(st.none(), st.integers(1, 2)),
        st.sampled_from(["signup", "purchase", "view"]),
    ),
    max_size=14,
)


def plain_history(events):
    """The answer of a window per application, nulls last."""
    found = []
    for app in {event[2] for event in events}:
        own = sorted((e for e in events if e[2] == app), key=lambda e: [(x is None, x or 0) for x in e[1::-1]] + [e[3]])
        for event, following in zip(own, own[1:] + [None]):
            timed = following is not None and event[1] is not None and following[1] is not None
            found.append((app, event[0], event[3], round((following[1] - event[1]) * 60e6) if timed else None))
    return sorted(found, key=str)


def plain_responses(events, span):
    sent = {(e[2], e[0], e[1]) for e in events if e[3] == "signup" and e[2] is not None and e[1] is not None}
    found = []
    for app, event, minute in sent:
        inside = [e[1] for e in events if e[3] == "purchase" and e[2] == app and e[1] is not None and 0 <= e[1] - minute <= span]
        if inside:
            found.append((app, event, at(minute), len(inside), at(min(inside))))
    return sorted(found, key=str)


@settings(max_examples=12, deadline=None)
@given(events=ODD, stretch=st.sampled_from(["1 minute", "1 hour", "5 days"]))
def test_events_with_nulls_and_copies(spark, events, stretch):
    """Without a time, an application or an id, or logged twice: one answer, whatever the stretch."""
    timed = log(spark, *((i, None if m is None else at(m), app, status) for i, m, app, status in events))
    history = status_history(timed, stretch)
    assert rows(history, "application_id", "event_id", "status", "lasted_us") == plain_history(events)
    assert responses(timed, "1 hour") == plain_responses(events, 60)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_lengths_do_not_depend_on_the_session_zone(spark, zone):
    """The clocks go forward in one of the zones during the night."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        night = [(i, datetime(2024, 3, 31, i), 1, "a") for i in range(6)]
        found = status_history(log(spark, *night))
        assert {row.lasted_us for row in found.collect()} == {3_600_000_000, None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_busy_application_lies_in_many_tasks(spark):
    events = spark.range(4000).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, id) AS ts", "1 + id div 9000 AS application_id", "'a' AS status"
    )
    found = status_history(events, "1 day")
    layouts = [line for line in plan_of(found).splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_part" in line for line in layouts) == 2
    assert found.where("lasted_us IS NULL").count() == 1


def test_funnel(spark):
    events = log(
        spark, (1, at(3), 1, "view"), (2, at(1), 1, "view"), (3, at(2), 1, "signup"), (4, at(9), 2, "other")
    )
    found = stage_funnel(events, ["view", "signup"])
    assert rows(found, "application_id", "n_view", "first_view", "n_signup", "first_signup") == [
        (1, 2, at(1), 1, at(2)), (2, 0, None, 0, None),
    ]


def test_report_adds_up(spark, busy):
    found = status_report(log(spark, *busy)).collect()
    totals = {level: sum(row.n for row in found if row.level == level) for level in ("day", "status", "total")}
    assert set(totals.values()) == {len(busy)}
    assert [(row.status, row.day) for row in found if row.level == "total"] == [(None, None)]


def test_report_keeps_events_without_status_apart_from_totals(spark):
    found = status_report(log(spark, (1, at(0), 1, None), (2, at(0), 1, "a")))
    assert rows(found.where("level = 'status'"), "status", "n") == [("a", 1), (None, 1)]


def test_report_rolls_up_folded_rows(spark, busy):
    plan = plan_of(status_report(log(spark, *busy)))
    assert "HashAggregate" in plan.split("Expand")[1]


def test_windows(spark):
    events = log(spark, (1, at(0), 1, "a"), (2, at(59.9), 1, "a"), (3, at(60), 1, "a"), (4, at(60), 2, "b"))
    found = activity_windows(events, "1 hour")
    assert rows(found, "window_start", "status", "n") == [
        (at(0), "a", 2), (at(60), "a", 1), (at(60), "b", 1),
    ]


def test_event_at_the_cutoff_is_not_stale(spark):
    events = log(spark, (1, at(0), 1, "a"), (2, at(60), 1, "a"), (3, at(59), 2, "a"), (4, at(90), 3, "a"))
    found = stale_applications(events, "2024-01-01 01:00:00")
    assert rows(found, "application_id", "last_ts") == [(2, at(59))]


def responses_by_hand(events, span):
    found = []
    for event, sent_at, app, status in events:
        if status == "signup":
            inside = [
                ts for _, ts, other, kind in events
                if other == app and kind == "purchase" and sent_at <= ts <= sent_at + span
            ]
            if inside:
                found.append((app, event, sent_at, len(inside), min(inside)))
    return sorted(found, key=str)


def responses(events, span):
    found = responses_within(events.where("status = 'signup'"), events.where("status = 'purchase'"), span)
    return rows(found, "application_id", "event_id", "sent_at", "n_answers", "first_answer")


@pytest.mark.parametrize("hours", [1, 2, 30])
def test_responses_by_hand(spark, busy, hours):
    want = responses_by_hand(busy, timedelta(hours=hours))
    assert responses(log(spark, *busy), f"{hours} hours") == want
    assert len(want) > 100


def test_both_ends_of_the_span_count(spark):
    events = log(
        spark, (1, at(0), 1, "signup"), (2, at(0), 1, "purchase"), (3, at(60), 1, "purchase"),
        (4, at(61), 1, "purchase"), (5, at(-1), 1, "purchase"), (6, at(0), 2, "signup"), (7, at(10), 3, "purchase"),
    )
    assert responses(events, "1 hour") == [(1, 1, at(0), 2, at(0))]


def test_responses_form_no_pairs(spark, busy):
    events = log(spark, *busy)
    found = responses_within(events.where("status = 'signup'"), events.where("status = 'purchase'"), "1 hour")
    assert "Join" not in plan_of(found)


def test_log_is_read_by_day(spark, tmp_path):
    folder = str(tmp_path / "log")
    events = log(spark, *((i, at(600 * i), i % 3, "a") for i in range(20))).selectExpr(
        "*", "1.5D AS value", "'{}' AS props"
    )
    append_log(events.where("event_id < 12"), folder)
    for _ in range(2):  # a batch that is written again replaces itself
        append_log(events.where("event_id >= 12"), folder, batch=1)
    found = read_log(spark, folder)
    assert rows(found, "event_id", "ts") == rows(events, "event_id", "ts")
    one_day = found.where("day = DATE'2024-01-03'")
    assert {row.event_id for row in one_day.collect()} == {5, 6, 7}
    assert "PartitionFilters: [isnotnull(day" in plan_of(one_day)
