"""Connected components by contraction, with DataFrame joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.sources.shared import stored

#: Times that parents are replaced by their parents in a round.
JUMPS = 3
#: So many edges, 3 MB, are contracted in one task: a bound that does not grow with the input.
FEW = 200_000


def _tidy(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(ends.where("a < b").distinct(), "edges")


def _above(found: DataFrame, roots: DataFrame) -> DataFrame:
    """``found`` with its roots replaced by theirs."""
    above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
    found = found.join(above, "root", "left")
    return stored(found.select("node", F.coalesce("above", "root").alias("root")), "roots")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.zeros((2, 0), np.int64)]
    ends += [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
    nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root the smallest node it reaches.

    In every round each node takes its smallest neighbour as parent if that is smaller than itself,
    parents are followed a few steps, and the edges are rewritten to the parents. Edges inside
    a tree vanish, so a hub's edges are gone after a round, and a path gets several times
    shorter; the number of rounds grows with the logarithm of the longest path. All
    aggregates are minima, which are folded before they are shuffled. The last ``FEW`` edges take one more
    step in one task. Nulls join nothing.
    """
    edges = _tidy(edges)
    found = None
    while left := edges.count():
        if left <= FEW:
            jumped = stored(edges.coalesce(1).mapInArrow(_few, "node long, root long"), "last-roots")
            return jumped if found is None else _above(found, jumped)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b"))
        parents = parents.select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        parents = stored(parents, "parents")
        # Each is read from the last one stored, so that a lost task is worked out from there.
        jumped = parents
        for _ in range(JUMPS):
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = jumped.join(above, "root", "left")
            jumped = jumped.select("node", F.coalesce("above", "root").alias("root"))
        jumped = stored(jumped, "jumped")
        found = jumped if found is None else _above(found, jumped)
        for end in ("a", "b"):
            above = jumped.select(F.col("node").alias(end), "root")
            edges = edges.join(above, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = _tidy(edges)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return found
