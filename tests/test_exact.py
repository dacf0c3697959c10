"""Reports that are exact beyond the size where sketches are."""

import random
from datetime import timedelta

import duckdb
import pytest
from helpers import T0

from jobtrail import plans
from jobtrail.operators import exact_quantiles
from jobtrail.sources.tables import SCHEMAS


@pytest.fixture(scope="module")
def large_log(spark, tmp_path_factory):
    """20,000 events of 6,000 applications: more than sketches hold exactly; some without a status or an application."""
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("large")
    events = [
        (i, T0 + timedelta(microseconds=rng.randrange(9 * 86_400_000_000)), None if i % 97 == 0 else rng.randrange(6000),
         None if i % 89 == 0 else rng.choice("ab"), 0.0, "")
        for i in range(20_000)
    ]
    spark.createDataFrame(events, SCHEMAS["events"]).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["application_report", "duration_quantiles"])
def test_report_equals_sql_beyond_sketches(spark, large_log, name):
    got = plans.QUERIES[name](spark, large_log)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{large_log}/events.parquet/*.parquet'")
    want = db.execute(plans.ORACLES[name]).fetchall()
    columns = [column[0] for column in db.description]
    assert sorted(map(str, want)) == sorted(str(tuple(row)) for row in got.select(columns).collect())


def test_quantiles_of_far_apart_and_equal_durations(spark):
    found = [0] * 7 + [1, 2**21 - 1, 2**21, 2**42, 2**42 + 1, 2**62, -(2**50), -1]
    daily = spark.createDataFrame([("a", us) for us in found] + [(None, 5)], "status string, lasted_us bigint")
    quantiles = {f"q{i}": i / 20 for i in range(21)}
    got = {row.status: row for row in exact_quantiles(daily, quantiles).collect()}
    us = sorted(found)
    assert [got["a"][name] for name in quantiles] == [us[max(1, -(-i * len(us) // 20)) - 1] for i in range(21)]
    assert got["a"].n == len(us) and set(got[None][name] for name in quantiles) == {5}
    assert exact_quantiles(daily.limit(0), quantiles).collect() == []
