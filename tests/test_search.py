"""Stored postings: the same best roles as reading all texts, batch by batch, and blocks that are skipped."""

import random

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from jobtrail.operators import (
    bucket_bounds,
    keyword_score,
    keyword_weights,
    posting_weights,
    search_roles,
    top_roles,
)
from jobtrail.sources import add_postings, read_postings, stored

ROLES = "role_id bigint, lang string, n_chars bigint, text string"
PREFS = "profile_id string, lang string, min_chars bigint, max_chars bigint"
PROFILES = "profile_id string, text string"


def table(rng, n):
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    found = [(n + 1, None, 10, "waa wba"), (n + 2, "en", None, "waa"), (n + 3, "en", 5, None), (n + 4, "en", 5, "")]
    for role in range(n):
        text = " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(200)], k=rng.randrange(1, 60)))
        found.append((role, rng.choice(("en", "en", "de")), len(text), text))
    return found


@pytest.fixture(scope="module")
def roles():
    return table(random.Random(8), 700)


@pytest.fixture(scope="module")
def search(spark):
    prefs = stored(spark.createDataFrame([("a", "en", 0, 500), ("b", "en", 40, 90), ("c", "de", 0, 500), ("d", "fr", 0, 9)], PREFS), "p")
    profiles = spark.createDataFrame(
        [("a", "waa wba wea Wzz"), ("a", "wcb wdb"), ("b", "wab wac wad"), ("c", "waa nothing"), ("d", "waa"), ("e", None)], PROFILES
    )
    return prefs, profiles


def by_reading(roles, search, k):
    prefs, profiles = search
    return top_roles(keyword_score(roles, prefs, stored(keyword_weights(roles, profiles), "w")), k)


def by_postings(spark, folder, search, k, **more):
    prefs, profiles = search
    held, blocks = read_postings(spark, folder)
    weights = stored(posting_weights(held, blocks, profiles), "w")
    return search_roles(blocks, prefs, weights, k, **more)


COLUMNS = ("profile_id", "rank", "role_id", "score")


@pytest.mark.parametrize(("k", "seeds"), [(1, 1), (10, 1), (10, 8), (100_000, 2)])
def test_search_equals_reading_all_texts(spark, roles, search, tmp_path, k, seeds):
    index = str(tmp_path / "index")
    given = spark.createDataFrame(roles, ROLES)
    for batch in range(3):
        add_postings(given.where(F.pmod("role_id", F.lit(3)) == batch), index, batch, bucket=16)
    got = by_postings(spark, index, search, k, seeds=seeds)
    assert rows(got, *COLUMNS) == rows(by_reading(given, search, k), *COLUMNS)


def test_batches_are_added_without_those_before(spark, roles, search, tmp_path):
    index = str(tmp_path / "index")
    first, second = spark.createDataFrame(roles[:400], ROLES), spark.createDataFrame(roles[400:], ROLES)
    add_postings(first, index, 0)
    files = {path: path.stat().st_mtime_ns for path in tmp_path.rglob("batch=0/**/*.parquet")}
    assert rows(by_postings(spark, index, search, 10), *COLUMNS) == rows(by_reading(first, search, 10), *COLUMNS)
    # The first batch's texts are gone by now; it stays as it was written.
    add_postings(second, index, 1)
    assert files == {path: path.stat().st_mtime_ns for path in files}
    both = spark.createDataFrame(roles, ROLES)
    assert rows(by_postings(spark, index, search, 10), *COLUMNS) == rows(by_reading(both, search, 10), *COLUMNS)
    # A batch that is indexed again replaces itself.
    add_postings(first, index, 1)
    twice = by_postings(spark, index, search, 10)
    assert rows(twice, *COLUMNS) == rows(by_reading(first.unionByName(first), search, 10), *COLUMNS)


def test_search_reads_no_text_and_skips_buckets(spark, search, tmp_path):
    """Long roles that say a wanted word often lie in few buckets; the others cannot reach them."""
    index = str(tmp_path / "index")
    found = [(i, "en", 40, "waa " + "filler " * 5) for i in range(600)]
    found += [(1000 + i, "en", 400, "waa " * (90 + i)) for i in range(20)]
    found += [(2000 + i, "en", 30, "other words") for i in range(600)]
    given = spark.createDataFrame(found, ROLES)
    add_postings(given, index, 0, bucket=32)
    prefs = search[0]
    held, blocks = read_postings(spark, index)
    assert "text" not in held.columns + blocks.columns
    weights = stored(posting_weights(held, blocks, search[1]), "w")
    bounds = bucket_bounds(blocks, prefs, weights).where("profile_id = 'a'")
    all_bounds = sorted((row.bound for row in bounds.collect()), reverse=True)
    best = by_postings(spark, index, search, 10, seeds=1).where("profile_id = 'a'").collect()
    least = min(row.score for row in best) * 1_000_000
    assert len(all_bounds) > 10 and sum(bound >= least for bound in all_bounds) <= 2
    assert rows(by_postings(spark, index, search, 10), *COLUMNS) == rows(by_reading(given, search, 10), *COLUMNS)
    assert "text:string" not in plan_of(search_roles(blocks, prefs, weights, 10))


def test_search_of_nothing(spark, search, tmp_path):
    index = str(tmp_path / "index")
    held, blocks = read_postings(spark, index)
    assert held.count() == 0
    add_postings(spark.createDataFrame([], ROLES), index, 0)
    assert by_postings(spark, index, search, 5).collect() == []
