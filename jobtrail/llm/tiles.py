"""Near-duplicate embeddings by int8 tile products (operator 2).

Vectors of a label are dealt into blocks, blocks into sides, and every two blocks of a label meet in one tile,
in the square of their sides. In a tile both blocks are scaled to length one and quantised to int8, each vector with its own
step, and one matrix product gives all dot products of the quantised vectors exactly: they are sums
of integers that floats hold. With u = q + e for a unit vector u, its quantised form q and
the error e,

    |u.v - q.r| <= |e| |r| + |f|,    v = r + f,

so |e| (1 + |f|) + |f| bounds the error of a pair. Only pairs that may reach the threshold
within that bound are worked out again from the given components in double precision, and that value decides.

Equal vectors of a label are one vector with a number, so copies cost nothing. A tile gives out
a row per linked vector: how many it is linked with, and the smallest member of the part of the tile
it hangs together with. A dense cluster thus gives rows in proportion to its vectors, not to its links.

Vectors with a null label, a null or non-finite component, no component or length zero link with nothing, and vectors of
different lengths don't link. Rows repeated with their id are vectors of their own; ``kept`` compares ids, so all rows
with the id of the component are kept. A null id is allowed and never a component's id unless
there is no other. Other columns, whatever their names, are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import quoted
from jobtrail.llm.components import components
from jobtrail.sources.shared import stored

THRESHOLD = 0.98
#: Components of a block: 4096 vectors of 64, or fewer longer ones.
BLOCK = 1 << 18
#: Blocks of one side of a square, at most: 16 blocks, 32 MB, in a task. Labels of few blocks have shorter
#: sides, so that they are still the work of many tasks.
SIDE = 8
#: Rows of one block that are multiplied at a time.
STRIP = 512
#: Sums of this many products of two int8 are whole numbers that float32 holds.
EXACT = 1024
#: Covers the rounding of the bound itself and of the double product.
ROUNDING = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, step, error): int8 codes as float32, the step of each row, and the length of
    what rounding takes away from it."""
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None])
    error = np.sqrt(((unit - codes * step[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.float32), step, error * (1 + 1e-12)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought near length one by powers of two, which changes no cosine and overflows nowhere."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = 0.0
    for start in range(0, a.shape[1], EXACT):
        total = total + (a[:, start : start + EXACT] @ b[:, start : start + EXACT].T).astype(np.float64)
    return total


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of linked rows of ``x`` and ``y``, or with i < j in ``x`` alone, in strips."""
    alone = y is None
    x = _scaled(x)
    y = x if alone else _scaled(y)
    unit_x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    unit_y = unit_x if alone else y / np.sqrt((y * y).sum(axis=1))[:, None]
    code_x, step_x, error_x = quantise(unit_x)
    code_y, step_y, error_y = (code_x, step_x, error_x) if alone else quantise(unit_y)
    for start in range(0, len(x), STRIP):
        rows = slice(start, start + STRIP)
        first = start if alone else 0
        upper = _dots(code_x[rows], code_y[first:]) * step_x[rows, None] * step_y[None, first:]
        upper += error_x[rows, None] * (1 + error_y[None, first:]) + error_y[None, first:] + ROUNDING
        i, j = np.nonzero(upper >= threshold)
        i, j = i + start, j + first
        if alone:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            xa, yb = x[a], y[b]
            dot = (xa * yb).sum(axis=1)
            cosine = dot / (np.sqrt((xa * xa).sum(axis=1)) * np.sqrt((yb * yb).sum(axis=1)))
            near = cosine >= threshold
            yield a[near], b[near]


def _smallest(count: int, pairs: list) -> np.ndarray:
    """The smallest place each place is connected with."""
    root = np.arange(count)
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            a, b = root[i], root[j]
            if (a != b).any():
                low, moved = np.minimum(a, b), True
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]
    return root


def _pack(rows: pa.Table) -> pa.Table:
    vectors = rows.column("vector").combine_chunks()
    one = {"block": rows["block"][0].as_py(), "label": rows["label"][0].as_py(), "dim": rows["dim"][0].as_py()}
    ids = rows.column("uid").to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = vectors.flatten().to_numpy().reshape(len(ids), -1)[order]
    return pa.table(
        {
            "label": pa.array([one["label"]], pa.int64()),
            "dim": pa.array([one["dim"]], pa.int32()),
            "block": pa.array([one["block"]], pa.int64()),
            "blocks": pa.array([rows["blocks"][0].as_py()], pa.int64()),
            "uids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
            "numbers": pa.array([rows.column("n").to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([flat.astype("<f8").tobytes()], pa.binary()),
        }
    )


def _square(threshold: float):
    """The links of each tile of a square: of each two blocks of its two sides, or of its one side."""
    schema = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def column(rows: pa.Table, name: str, at: int, kind: str) -> np.ndarray:
        return np.frombuffer(rows[name][at].as_buffer(), kind)

    def tile(rows: pa.Table, parts: list[int]) -> pa.Table:
        dim = rows["dim"][0].as_py()
        uid = [column(rows, "uids", at, "<i8") for at in parts]
        vector = [column(rows, "vectors", at, "<f8").reshape(-1, dim) for at in parts]
        second = vector[1] if len(parts) > 1 else None
        shift = len(uid[0]) if second is not None else 0
        uids, numbers = np.concatenate(uid), np.concatenate([column(rows, "numbers", at, "<i8") for at in parts])
        count, pairs = np.zeros(len(uids), np.int64), []
        for i, j in linked_pairs(vector[0], second, threshold):
            j = j + shift
            np.add.at(count, i, numbers[j])
            np.add.at(count, j, numbers[i])
            pairs.append((i, j))
        root = _smallest(len(uids), pairs)
        linked = np.nonzero(count)[0]
        return pa.table({"uid": uids[linked], "links": count[linked], "root": uids[root[linked]]}, schema=schema)

    def links(rows: pa.Table) -> pa.Table:
        place = {block: at for at, block in enumerate(rows["block"].to_pylist())}
        side = dict(zip(rows["block"].to_pylist(), rows["side"].to_pylist()))
        one_side = rows["i"][0].as_py() == rows["j"][0].as_py()
        found = []
        for a in sorted(place):
            if one_side:
                found.append(tile(rows, [place[a]]))
            for b in sorted(place):
                if a < b and (one_side or side[a] != side[b]):
                    found.append(tile(rows, [place[a], place[b]]))
        return pa.concat_tables(found) if found else schema.empty_table()

    return links


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``."""
    rows = vectors.select(
        quoted(key).alias("id"),
        quoted(label).cast("long").alias("label"),
        quoted(vector).cast("array<double>").alias("vector"),
    )
    infinite = F.lit(float("inf"))
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    fit = fit & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    usable = rows.where("fit")
    groups = usable.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    groups = groups.withColumn("dim", F.size("vector")).withColumn("uid", F.monotonically_increasing_id())
    groups = stored(groups, "vectors")

    kinds = groups.groupBy("label", "dim").agg(F.count("*").alias("kind_rows"))
    per_block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("dim")))
    kinds = kinds.withColumn("blocks", F.ceil(F.col("kind_rows") / per_block)).drop("kind_rows")
    dealt = groups.join(kinds, ["label", "dim"]).withColumn(
        "block", F.pmod(F.xxhash64("vector"), F.col("blocks"))
    )
    packed = "label long, dim int, block long, blocks long, uids binary, numbers binary, vectors binary"
    blocks = dealt.select("label", "dim", "block", "blocks", "uid", "n", "vector")
    blocks = stored(blocks.groupBy("label", "dim", "block").applyInArrow(_pack, packed), "blocks")
    # Every two sides of a label are a square, and every two blocks of its sides a tile of it. A block thus moves
    # once per side, not once per block.
    met = blocks.withColumn("wide", F.least(F.lit(SIDE), F.ceil(F.col("blocks") / SIDE)))
    met = met.withColumn("side", F.floor(F.col("block") / F.col("wide")))
    last = F.floor((F.col("blocks") - 1) / F.col("wide"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    met = met.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    met = met.drop("other", "wide", "blocks")
    squares = met.groupBy("label", "dim", "i", "j")
    links = stored(squares.applyInArrow(_square(threshold), "uid long, links long, root long"), "links")

    roots = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("uid").agg(F.sum("links").alias("links"))
    known = groups.join(counts, "uid", "left")
    known = known.join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    known = known.withColumn("root", F.coalesce("root", "uid"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select("label", "vector", "n", "links", "component_id")
    linked = usable.join(known, ["label", "vector"]).select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    single = rows.where(~F.col("fit")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(single).withColumn("kept", kept).withColumnRenamed("id", key)
