"""Nearest roles by vector: coarse cells, probed by a search, and the cells an exact search still needs.

Scores are cosines. Vectors that are null or zero, or hold a null or a component that is not finite, are in no cell and
near nothing; neither is one whose length differs from that of the centres. Ties go to the smaller id. Roles repeated with their id are
rows of their own, roles without an id are never found, and searches have ids of their own. An empty table has no cells and gives no rows.

The searches that ask for a cell and its roles meet in tiles of bounded size, each a matrix product in a task, which hands on the best of
each search only. The product decides unless it lies next to where rounding changes the score; then the sum in order does.
"""

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells at most, and vectors the centres are fitted on at most. All vectors are then dealt to the cells.
CELLS = 64
FITTED = 20_000
#: Cells a search looks into at first: enough for nine tenths of the best ten among vectors without any clusters.
PROBES = 40
#: Scores are compared to this many decimals, and cells looked into if they may reach a score but for MARGIN.
PLACES = 9
MARGIN = 1e-7
#: Components of the searches of a tile, and of its roles: 16,384 vectors of 64, or fewer longer ones.
TILE = 1 << 20
#: Searches and roles of a tile that are multiplied at a time.
STRIP, COLUMNS = 512, 2048


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if one of them is longer."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _divided(x: Column, by: Column) -> Column:
    """Each component by the same number, which is worked out once and not for each of them."""
    return F.transform(F.array(by), lambda size: F.transform(x, lambda value: value / size))[0]


def units(vectors: DataFrame) -> DataFrame:
    """(role_id, unit): the vectors that have a direction, at length one in double."""
    given = vectors.select("role_id", F.col("embedding").cast("array<double>").alias("x"))
    # Scaled by the largest component first, so that no square overflows or vanishes.
    largest = F.array_max(F.transform("x", F.abs))
    known = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x)) & (largest > 0) & (largest < float("inf"))
    given = given.where(known).select("role_id", _divided(F.col("x"), largest).alias("x"))
    return given.select("role_id", _divided(F.col("x"), F.sqrt(dot(F.col("x"), F.col("x")))).alias("unit"))


def fit_centres(directions: DataFrame, cells: int = CELLS, fitted: int = FITTED) -> DataFrame:
    """(cell, centre) by k-means over the ``fitted`` directions with the smallest hashes, of the commonest length."""
    spark = directions.sparkSession
    lengths = directions.groupBy(F.size("unit").alias("length")).agg(F.count("*").alias("n"))
    length = lengths.orderBy(F.desc("n"), "length").first()
    centres = []
    if length:
        chosen = directions.where(F.size("unit") == length[0]).orderBy(F.xxhash64("unit"), "role_id").limit(fitted)
        few = [row.unit for row in chosen.select("unit").distinct().limit(cells + 1).collect()]
        if len(few) <= cells:
            centres = sorted(few)
        else:
            # The sample is bounded; in one partition the centres don't depend on the layout.
            chosen = chosen.select(array_to_vector("unit").alias("features")).coalesce(1)
            centres = KMeans(k=cells, seed=1, maxIter=8).fit(chosen).clusterCenters()
    sizes = [sum(float(x) ** 2 for x in centre) ** 0.5 for centre in centres]
    found = [(cell, [float(x) / sizes[cell] for x in centre]) for cell, centre in enumerate(centres) if sizes[cell]]
    return spark.createDataFrame(found, "cell int, centre array<double>")


def _all(centres: DataFrame, *columns: str) -> Column:
    """All centres as one array, which CELLS bounds."""
    return centres.agg(F.collect_list(F.struct(*columns))).scalar()


def deal_cells(directions: DataFrame, centres: DataFrame) -> DataFrame:
    """(cell, role_id, unit, angle): each direction in the cell of its nearest centre, and how far it is from that.

    Fetches the centres, which CELLS bounds.
    """
    known = centres.orderBy("cell").collect()
    cells = np.array([row.cell for row in known], np.int32)
    middles = np.array([row.centre for row in known], np.float64).T

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column("unit")
            near = unit.flatten().to_numpy().reshape(len(unit), len(middles)) @ middles
            best = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(unit)), best], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[best]), batch.column("role_id"), unit, pa.array(angle)], ["cell", "role_id", "unit", "angle"]
            )

    kind = directions.schema["role_id"].dataType.simpleString()
    fit = directions.where(F.size("unit") == len(middles)) if known else directions.where("false")
    return fit.select("role_id", "unit").mapInArrow(deal, f"cell int, role_id {kind}, unit array<double>, angle double")


def cell_bounds(index: DataFrame, centres: DataFrame) -> DataFrame:
    """(cell, centre, radius, n) of the cells that hold something."""
    radius = index.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    return centres.join(radius, "cell")


def _wishes(searches: DataFrame, bounds: DataFrame) -> DataFrame:
    """(search_id, unit, cells): all cells, the best first, with the highest score each can hold."""

    def met(c: Column) -> Column:
        near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("unit"), c["centre"])))
        bound = F.cos(F.greatest(F.lit(0.0), F.acos(near) - c["radius"]))
        return F.struct(near.alias("near"), bound.alias("bound"), c["cell"].alias("cell"), c["n"].alias("n"))

    asked = searches.withColumn("bounds", _all(bounds, "cell", "centre", "radius", "n"))
    fit = F.exists("bounds", lambda c: F.size(c["centre"]) == F.size("unit"))
    asked = asked.where(fit).withColumn("cells", F.reverse(F.array_sort(F.transform("bounds", met))))
    return asked.select(F.col("role_id").alias("search_id"), "unit", "cells")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("search_id").orderBy(F.desc("score"), "role_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tile(k: int, places: int, strip: int, columns: int) -> Callable[[pa.Table], pa.Table]:
    """The best ``k`` roles of each search of a tile. Nothing it needs is outside, so it travels by value."""
    scale, step = 10**places, Decimal(1).scaleb(-places)
    schema = pa.schema([("search_id", pa.int64()), ("role_id", pa.int64()), ("score", pa.float64())])

    def rounded(products: np.ndarray, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, slack: float) -> np.ndarray:
        """Scores in units of the last place. ``products`` are those of x[i] and y[j], each within ``slack``."""
        size = np.abs(products) * scale
        whole = np.floor(size + 0.5)
        (near,) = np.nonzero(np.abs(size - np.floor(size) - 0.5) <= slack * scale + 1e-6)
        total = np.zeros(len(near))
        for at in range(x.shape[1]):
            total = total + x[i[near], at] * y[j[near], at]
        decided = [int(Decimal(repr(abs(value))).quantize(step, ROUND_HALF_UP).scaleb(places)) for value in total.tolist()]
        whole[near] = decided
        return (np.sign(products) * whole).astype(np.int64)

    def best(rows: pa.Table) -> pa.Table:
        wish = rows["wish"].to_numpy()
        ids = rows["id"].to_numpy()
        unit = rows["unit"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        asked, x = ids[wish], unit[wish]
        # No score is below -1, and one that can't be had is below that.
        floor = rows["least"].fill_null(-2.0).to_numpy()[wish]
        order = np.argsort(ids[~wish], kind="stable")
        roles, y = ids[~wish][order], unit[~wish][order]
        slack = (unit.shape[1] + 8) * 2.0**-52
        found = [schema.empty_table()]
        for start in range(0, len(x), strip):
            part, names = x[start : start + strip], asked[start : start + strip]
            own_from, own_to = np.searchsorted(roles, names), np.searchsorted(roles, names, "right")
            cut = floor[start : start + strip] - 1 / scale
            r, c, score = (np.zeros(0, np.int64) for _ in range(3))
            for first in range(0, len(y), columns):
                product = part @ y[first : first + columns].T
                wide = product.shape[1]
                # A search does not find roles of its own id.
                own = (own_from < own_to) & (own_from < first + wide) & (own_to > first)
                for row in np.nonzero(own)[0].tolist():
                    product[row, max(own_from[row] - first, 0) : own_to[row] - first] = -np.inf
                if not first and wide >= k:
                    cut = np.maximum(cut, np.partition(product, wide - k, axis=1)[:, wide - k] - 2 / scale)
                i, j = np.nonzero(product >= cut[:, None])
                value = rounded(product[i, j], part, y, i, j + first, slack)
                r, c, score = np.append(r, i), np.append(c, j + first), np.append(score, value)
                order = np.lexsort((c, -score, r))
                order = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < k]
                r, c, score = r[order], c[order], score[order]
                # Roles come by their ids, so a later one must score higher than the k-th.
                count = np.bincount(r, minlength=len(part))
                full = count == k
                above = (score[np.cumsum(count)[full] - 1] + 0.5) / scale - slack
                cut[full] = np.maximum(cut[full], above - 2.0**-52)
            found.append(pa.table([names[r], roles[c], score / scale], schema=schema))
        return pa.concat_tables(found)

    return best


def _scores(searches: DataFrame, wishes: DataFrame, cells: Column, index: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """(search_id, role_id, score): of each tile of the cells a search asks for, the best ``k``.

    A cell has tiles of searches (i) and of roles (j), and every two of them meet. Roles are dealt by their number in the stored index.
    """
    asked = wishes.select("search_id", "unit", "least", F.explode(cells).alias("c"))
    parts = searches.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("unit")) / TILE))).scalar()

    def last(n: Column) -> Column:
        return F.ceil(n * F.size("unit") / TILE) - 1

    wished = asked.select(
        "c.cell", F.pmod(F.xxhash64("search_id"), parts).alias("i"), F.explode(F.sequence(F.lit(0), last(F.col("c.n")))).alias("j"),
        F.col("search_id").alias("id"), "unit", "least", F.lit(True).alias("wish"),
    )
    # Cells that no search asks for are not read.
    wanted = asked.agg(F.collect_set("c.cell")).scalar()
    sizes = F.map_from_entries(_all(bounds, "cell", "n"))
    roles = index.where(F.array_contains(wanted, F.col("cell")) & F.col("role_id").isNotNull())
    roles = roles.withColumn("j", F.pmod(F.xxhash64(F.monotonically_increasing_id()), last(F.element_at(sizes, F.col("cell"))) + 1))
    roles = roles.select(
        "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"), "j",
        F.col("role_id").alias("id"), "unit", F.lit(None).cast("double").alias("least"), F.lit(False).alias("wish"),
    )
    tiles = wished.unionByName(roles).groupBy("cell", "i", "j")
    return tiles.applyInArrow(_tile(k, PLACES, STRIP, COLUMNS), "search_id long, role_id long, score double")


def probe(searches: DataFrame, index: DataFrame, bounds: DataFrame, k: int = 10, probes: int = PROBES) -> DataFrame:
    """(search_id, role_id, score, rank): the best ``k`` other roles in the ``probes`` nearest cells of each search."""
    wishes = _wishes(searches, bounds).withColumn("least", F.lit(None).cast("double"))
    return _best(_scores(searches, wishes, F.slice("cells", 1, probes), index, bounds, k), k)


def nearest(
    searches: DataFrame, index: DataFrame, bounds: DataFrame, found: DataFrame, k: int = 10, probes: int = PROBES
) -> DataFrame:
    """The best ``k`` of all: what ``probe`` with the same numbers ``found``, and what other cells add.

    A direction lies within its cell's radius of the centre, so by the triangle inequality of angles no score in a cell is higher
    than its bound; cells whose bound is below the k-th score are not read. Hand in what was found stored.
    """
    least = found.groupBy("search_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # A search that found fewer than k takes whatever scores.
    least = least.select("search_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    wishes = _wishes(searches, bounds).join(least, "search_id", "left")
    rest = F.slice("cells", F.lit(probes + 1), F.size("cells"))
    rest = F.filter(rest, lambda c: F.col("least").isNull() | (c["bound"] >= F.col("least") - MARGIN))
    return _best(found.drop("rank").unionByName(_scores(searches, wishes, rest, index, bounds, k)), k)
