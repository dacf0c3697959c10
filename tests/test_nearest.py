"""Nearest roles by cells: recall of a probe, exactness of the whole search, awkward vectors."""

import sys
import time

import numpy as np
import pytest
from helpers import rows

from jobtrail.operators import cell_bounds, deal_cells, fit_centres, nearest, probe, units
from jobtrail.plans.score import nearest_probed, nearest_roles
from jobtrail.sources import stored, stored_by

VECTORS = "role_id bigint, embedding array<float>"
NAN, INF = float("nan"), float("inf")
SF = "/root/testdata/sf0.01"


def index_of(df, cells):
    directions = stored(units(df), "directions")
    centres = stored(fit_centres(directions, cells=cells, fitted=200), "centres")
    index = stored_by(deal_cells(directions, centres), "cells", "cell")
    return directions, index, stored(cell_bounds(index, centres), "bounds")


def brute(vectors, searches, k):
    """Best ``k`` by numpy; ``vectors`` are (id, vector) with a direction."""
    ids = np.array([key for key, _ in vectors])
    x = np.array([vector for _, vector in vectors], np.float32).astype(float)
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    found = {}
    for at in np.nonzero(np.isin(ids, searches))[0]:
        scores = np.round(x @ x[at], 9)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[at]][:k]
        found[int(ids[at])] = [(int(ids[i]), float(scores[i])) for i in order]
    return found


def by_search(df):
    found = {}
    for row in df.orderBy("search_id", "rank").collect():
        found.setdefault(row.search_id, []).append((row.role_id, row.score))
    return found


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    made = [(i, centres[i % 12] + rng.normal(size=16) * 0.4) for i in range(600)]
    made += [(600 + i, made[0][1]) for i in range(40)]  # copies tie
    made += [(700, made[1][1] * 1e20), (701, made[2][1] * 1e-20)]
    return [(key, [float(np.float32(x)) for x in vector]) for key, vector in made]


def test_exact_search_equals_brute_force(spark, vectors):
    odd = [None, [], [0.0] * 16, [NAN] * 16, [INF] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 9]
    df = spark.createDataFrame(vectors + [(800 + i, vector) for i, vector in enumerate(odd)], VECTORS)
    directions, index, bounds = index_of(df, 10)
    wanted = [key for key, _ in vectors if key % 20 == 0]
    searches = directions.where("role_id % 20 = 0")
    expected = brute(vectors, wanted, 10)
    for probes in (1, 3, 10):
        found = stored(probe(searches, index, bounds, 10, probes), "probed")
        assert by_search(nearest(searches, index, bounds, found, 10, probes)) == expected
    # A search that finds fewer than k in its cells goes on to all of them.
    found = stored(probe(searches, index, bounds, 500, 1), "probed")
    assert by_search(nearest(searches, index, bounds, found, 500, 1)) == brute(vectors, wanted, 500)


def test_every_vector_with_a_direction_is_in_a_cell(spark, vectors):
    _, index, bounds = index_of(spark.createDataFrame(vectors, VECTORS), 10)
    assert rows(index, "role_id") == sorted(((key,) for key, _ in vectors), key=str)
    assert {row.cell for row in bounds.collect()} == {row.cell for row in index.select("cell").distinct().collect()}


def test_recall_of_a_probe(spark):
    exact, probed = (by_search(query(spark, SF)) for query in (nearest_roles, nearest_probed))
    hits = sum(len(set(exact[key]) & set(probed.get(key, []))) for key in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))


@pytest.mark.parametrize("given", [[], [(1, None), (20, [0.0, 0.0])], [(20, [1.0, 2.0])]])
def test_small_tables(spark, given):
    directions, index, bounds = index_of(spark.createDataFrame(given, VECTORS), 4)
    found = stored(probe(directions, index, bounds), "probed")
    assert nearest(directions, index, bounds, found).collect() == []


def test_tiles_of_cells_hand_on_the_best_only(spark, vectors, monkeypatch):
    module = sys.modules["jobtrail.operators.nearest"]
    # Tiles of 20 vectors, multiplied 7 searches and 6 roles at a time.
    for name, value in {"TILE": 20 * 16, "STRIP": 7, "COLUMNS": 6}.items():
        monkeypatch.setattr(module, name, value)
    again = [(20, vectors[0][1]), (0, vectors[5][1]), (None, vectors[1][1])]  # ids that repeat, and none
    directions, index, bounds = index_of(spark.createDataFrame(vectors + again, VECTORS), 4)
    once = directions.where("role_id % 20 = 0 AND role_id NOT IN (0, 20)")
    known = vectors + again[:2]
    expected = brute(known, [key for key, _ in vectors if key % 20 == 0 and key > 20], 10)
    for probes in (1, 4):
        found = stored(probe(once, index, bounds, 10, probes), "probed")
        assert by_search(nearest(once, index, bounds, found, 10, probes)) == expected
    sizes = {row.cell: row.n for row in bounds.collect()}
    assert sum(sizes.values()) == len(known) + 1
    wishes = module._wishes(once, bounds).selectExpr("*", "CAST(NULL AS double) AS least")
    handed = module._scores(once, wishes, wishes["cells"], index, bounds, 3).groupBy("search_id").count()
    tiles = sum(-(-n // 20) for n in sizes.values())
    assert max(row["count"] for row in handed.collect()) <= 3 * tiles < len(known)


def test_scores_are_rounded_as_spark_does(spark):
    # Products within a few units of the last place of where rounding changes, of both signs.
    rng = np.random.default_rng(3)
    halves = (rng.integers(-(10**9), 10**9, 400) + 0.5) / 1e9
    halves = np.concatenate([halves, np.nextafter(halves, 2), np.nextafter(halves, -2)])
    given = [(20, [1.0, 0.0])] + [(1000 + i, [float(x), float(np.sqrt(1 - x * x))]) for i, x in enumerate(halves)]
    directions = spark.createDataFrame([(key, unit) for key, unit in given], "role_id bigint, unit array<double>")
    index = directions.selectExpr("0 AS cell", "role_id", "unit", "acos(unit[0]) AS angle")
    centres = spark.createDataFrame([(0, [1.0, 0.0])], "cell int, centre array<double>")
    index, centres = stored(index, "cells"), stored(centres, "centres")
    found = probe(directions.where("role_id = 20"), index, cell_bounds(index, centres), len(given), 1)
    expected = directions.where("role_id > 20").selectExpr("role_id", "round(0.0D + 1.0D * unit[0] + 0.0D * unit[1], 9) AS score")
    assert rows(found, "role_id", "score") == rows(expected, "role_id", "score")


def test_units_take_time_in_proportion_to_their_length(spark):
    long = spark.range(4).selectExpr("id AS role_id", "transform(sequence(1, 20000), i -> CAST(i % 7 AS float)) AS embedding")
    units(long.limit(0)).collect()
    start = time.time()
    assert [round(row.n, 9) for row in units(long).selectExpr("aggregate(unit, 0D, (s, x) -> s + x * x) AS n").collect()] == [1.0] * 4
    assert time.time() - start < 10
