"""Shards: links kept together, sizes even, awkward rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import sharding

DOCS = "doc_id long, text string"


def sharded(spark, rows, shards=24):
    """(share of linked pairs that are cut, loads) of ``rows``, whose ids are their positions."""
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(3), shards=shards).collect()
    assert sorted(row.doc_id for row in got) == [key for key, _ in rows]
    groups, loads, slots = defaultdict(Counter), Counter(dict.fromkeys(range(shards), 0)), defaultdict(list)
    for row in got:
        groups[rows[row.doc_id][1]][row.shard] += 1
        loads[row.shard] += row.size
        slots[row.shard].append(row.slot)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    kept = sum(n * (n - 1) for found in groups.values() for n in found.values())
    pairs = sum(sum(found.values()) * (sum(found.values()) - 1) for found in groups.values())
    return 1 - kept / pairs, loads


def copies(groups, size, seed=5):
    rng = random.Random(seed)
    texts = [f"{group} " + "x" * rng.randint(60, 300) for group in range(groups)] * size
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("groups, size", [(120, 150), (1200, 15)])
def test_links_stay_whole_where_they_fill_the_shards(spark, groups, size):
    rows = copies(groups, size)
    cut, loads = sharded(spark, rows)
    mean = sum(loads.values()) / 24
    largest = max(len(text) + 8 for _, text in rows)
    assert cut <= 0.1
    assert max(abs(load - mean) for load in loads.values()) <= max(0.003 * mean, largest)


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(6)
    texts = ["the same text " * 5] * 6000 + [f"{i} " + "y" * rng.randint(30, 110) for i in range(12000)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    cut, loads = sharded(spark, rows)
    mean = sum(loads.values()) / 24
    # The group fills eight shards or so; in equal parts of eight, 7 of 8 pairs are cut.
    assert cut <= 0.9
    assert max(abs(load - mean) for load in loads.values()) <= max(0.003 * mean, 120)


def test_awkward_rows(spark):
    rows = [(None, None), (None, None), (None, ""), (2**53 + 1, "a"), (2**53 + 1, "a"), (3, "z" * 60000), (4, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns(
        {name: F.lit(1) for name in "group shard size goal start span cut kind class step wish a.b".split()}
    )
    for found in (docs, docs.repartition(5)):
        got = sharding.shard_documents(found, shards=3).collect()
        assert Counter(row.doc_id for row in got) == Counter(key for key, _ in rows)
        assert sum(row.size for row in got) == 60000 + 2 + 8 * len(rows)
        assert {row.shard for row in got} <= {0, 1, 2}
        # What is larger than a share has a shard of its own, or nearly.
        assert len({row.shard for row in got if row.doc_id == 2**53 + 1}) == 1


def test_the_layout_decides_nothing(spark):
    docs = spark.createDataFrame(copies(40, 20), DOCS)
    found = [
        sorted((row.doc_id, row.shard) for row in sharding.shard_documents(table, shards=6).collect())
        for table in (docs.coalesce(1), docs.repartition(7))
    ]
    assert found[0] == found[1]
