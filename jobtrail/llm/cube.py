"""Mixing sources to target weights by the cube method (operator 8).

A source's target over its size is the number of times each of its documents is wanted. The whole
part is taken as it stands; what remains is one fractional inclusion probability for all
documents of the source. The cube method turns those into zeros and ones and keeps
two totals of the source: the number of documents and the number of words taken. The flight
phase takes three undecided documents at a time, moves their probabilities along the one direction that
changes neither total, (b-c, c-a, a-b) for sizes a, b, c, until one of them reaches 0 or 1,
and goes on with the next document. At most two remain undecided.

The flight runs in blocks of a few thousand documents of one source, many at once. What
each leaves undecided is gathered in new blocks, and so on until each source
is one block. Only then the landing problem remains: at most two documents of a source,
decided so that the words taken come nearest to what was wanted, and a few flips of others.

A null text has no words, a very long one is one number. A null source is a source like others, ordered last. Sources
without words have target 0. Ids may be null, of any size, or repeat: every row is a document of its own, and rows are
told apart by a number that is written with them. Extra columns are kept by ``mixed_documents`` and not looked at; their
names may clash. An empty table gives an empty table. All choices come from hashes of id, text and source, so
reruns agree, also on a table that is laid out differently; among rows alike in all three, which ones are taken is
left to the layout.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import fresh, numbered, quoted
from jobtrail.sources.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
MOST = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Documents of a block of the flight phase. Each leaves two, so every level is this much smaller.
BLOCK = 4096
#: Documents that the landing may flip.
FLIPS = 3
#: Bits of a row's number below those of its partition (``monotonically_increasing_id``).
PART_BITS = 33
#: A probability this near to 0 or 1 is decided.
NEAR = 1e-9


def source_targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size, weight) with a target each: shares of all sizes by weight,
    at most ``most`` times the source's size, the excess reshared by weight until none is above.

    Every round is one aggregate; two numbers come to the driver, no row.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = most * F.col("source_size")
    capped, level = F.lit(False), -1.0
    while True:
        sums = sources.agg(
            F.sum(F.when(capped, limit).otherwise(0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        rate = (total - sums.fixed) / sums.weight if sums.weight else level
        if rate <= level:
            break
        # The rate only rises, so a source above its limit stays there.
        level = rate
        capped = F.col("weight") * level > limit
    target = F.when(capped, limit).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", target.cast("double"))


def weighted_sources(rows: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, source_rows, place, weight): places count the sources by code point, null last, and
    weights repeat over them."""
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    sources = numbered(sources, "place", F.col("source").asc_nulls_last())
    kinds = F.array(*map(F.lit, weights))
    weight = F.get(kinds, F.pmod("place", F.lit(len(weights))).cast("int"))
    return sources.select("source", "source_size", "source_rows", "place", weight.alias("weight"))


def flight(sizes: list, chances: list, draws: list) -> list[int]:
    """Decide ``chances`` in place as far as both totals allow; the places still undecided."""
    open_places: list[int] = []
    for place in range(len(sizes)):
        if NEAR < chances[place] < 1 - NEAR:
            open_places.append(place)
        if len(open_places) < 3:
            continue
        i, j, k = open_places
        move = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if not any(move):
            move = (1, -1, 0)
        up = down = math.inf
        for at, step in zip(open_places, move):
            if step > 0:
                up, down = min(up, (1 - chances[at]) / step), min(down, chances[at] / step)
            elif step < 0:
                up, down = min(up, chances[at] / -step), min(down, (1 - chances[at]) / -step)
        # Going up with this probability keeps every chance the same on average.
        length = up if draws[place] * (up + down) < down else -down
        for at, step in zip(open_places, move):
            chances[at] += length * step
            if chances[at] < NEAR:
                chances[at] = 0.0
            elif chances[at] > 1 - NEAR:
                chances[at] = 1.0
        open_places = [at for at in open_places if 0 < chances[at] < 1]
    for place, chance in enumerate(chances):
        if place not in open_places:
            chances[place] = float(chance > 0.5)
    return open_places


def land(sizes: list, chances: list, undecided: list[int]) -> None:
    """Decide the last documents: nearest words, then nearest number, then the fewest words.

    Where that leaves words over or short, up to ``FLIPS`` documents of the block that come
    nearest to the difference are flipped, as long as each brings the words nearer.
    """
    words = sum(sizes[at] * chances[at] for at in undecided)
    number = sum(chances[at] for at in undecided)
    best = None
    for choice in range(2 ** len(undecided)):
        taken = [at for bit, at in enumerate(undecided) if choice >> bit & 1]
        w = sum(sizes[at] for at in taken)
        cost = (abs(w - words), abs(len(taken) - number), w, choice)
        if best is None or cost < best[0]:
            best = (cost, taken)
    for at in undecided:
        chances[at] = float(at in best[1])
    short = words - sum(sizes[at] for at in best[1])
    for _ in range(FLIPS):
        gains = [(1 - 2 * chance) * size for size, chance in zip(sizes, chances)]
        at = min(range(len(gains)), key=lambda place: (abs(short - gains[place]), place))
        if abs(short - gains[at]) >= abs(short) - 0.5:
            break
        short -= gains[at]
        chances[at] = 1.0 - chances[at]


def _fly(block: pa.Table) -> pa.Table:
    """Only whole numbers without nulls and the chances pass through here; draws are distinct in a source."""
    block = block.sort_by([("draw", "ascending"), ("size", "ascending")])
    sizes, chances = block["size"].to_pylist(), block["chance"].to_pylist()
    left = flight(sizes, chances, [(draw >> 11) / 2**53 + 0.5 for draw in block["draw"].to_pylist()])
    if block["blocks"][0].as_py() == 1:
        land(sizes, chances, left)
    return block.set_column(block.schema.get_field_index("chance"), "chance", pa.array(chances, pa.float64()))


def _drawn(docs: DataFrame, key: str, text: str, source: str) -> list[Column]:
    """Source, words and draw of a row; rows that are alike in id, text and source are alike in all of them."""
    words = F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")
    kinds = [F.xxhash64(quoted(name), quoted(name).isNull()) for name in (key, text, source)]
    return [quoted(source).alias("source"), words.alias("size"), F.xxhash64(*kinds).alias("draw")]


def taken(rows: DataFrame) -> DataFrame:
    """``rows`` (uid, source, size, draw and others), which are stored, with source_size, target and times.

    Rows that are alike are one unit: of m of them, wanted c times each besides the whole times, the whole
    part of m c is taken, and the fraction left is the unit's chance in the flight. However many there are, the
    flight meets one row for them, and it meets the same units whatever the layout of the table.
    """
    sources = stored(source_targets(stored(weighted_sources(rows), "mix-sources")), "mix-targets")
    same = rows["source"].eqNullSafe(sources["source"])
    placed = rows.join(sources.drop("weight", "source_rows"), same).drop(sources["source"])
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = placed.withColumn("wanted", wanted).groupBy("place", "draw", "size")
    units = units.agg(F.count("*").alias("m"), F.first("wanted").alias("wanted"))
    share = F.col("m") * (F.col("wanted") - F.floor("wanted"))
    units = units.select(
        "place", "draw", "size", "m", F.floor("wanted").alias("whole"),
        F.floor(share).alias("sure"), (share - F.floor(share)).alias("chance"),
    )
    units = stored(units, "mix-units")
    numbers = units.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    numbers = stored(numbers, "mix-blocks")
    most_blocks = numbers.agg(F.max("blocks")).first()[0] or 0

    left, done, level = units.join(numbers, "place"), [], 0
    while True:
        block = F.pmod(F.xxhash64("draw", F.lit(level)), F.col("blocks"))
        dealt = left.withColumn("block", block)
        dealt = stored(dealt.groupBy("place", "block").applyInArrow(_fly, dealt.schema), "mix-flight")
        decided = F.col("chance").isin(0.0, 1.0)
        done.append(dealt.where(decided))
        if most_blocks <= 1:
            break
        left = dealt.where(~decided).drop("block")
        left = left.withColumn("blocks", F.ceil(2 * F.col("blocks") / BLOCK))
        most_blocks, level = math.ceil(2 * most_blocks / BLOCK), level + 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = found.select(
        "place", "draw", "size", "m", "whole", (F.col("sure") + F.col("chance").cast("long")).alias("some")
    )
    known = stored(placed.join(found, ["place", "draw", "size"]), "mix-known")

    # Which of several alike rows: the first by number. They are numbered by scan partition, which the upper
    # bits of uid name, so that very many of them are no single group.
    part = F.shiftright("uid", PART_BITS)
    alike = known.where("m > 1").select("uid", "place", "draw", "size", part.alias("part"))
    counts = alike.groupBy("place", "draw", "size", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place", "draw", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    keys = ["place", "draw", "size", "part"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("uid")) - 1
    numbered_rows = alike.withColumn("number", number).join(counts, keys)
    numbered_rows = numbered_rows.select("uid", (F.col("number") + F.col("before")).alias("nth"))
    known = known.join(numbered_rows, "uid", "left")
    more = F.coalesce("nth", F.lit(0)) < F.col("some")
    times = F.col("whole") + more.cast("long")
    return known.withColumn("times", times).drop("place", "draw", "m", "whole", "some", "nth")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, times) of every row of ``docs``."""
    rows = docs.select(quoted(key).alias("id"), *_drawn(docs, key, text, source))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    return taken(rows).select(F.col("id").alias(key), "source", "size", "source_size", "target", "times")


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The rows of ``docs`` with all columns, each as often as the mix takes it, in no order.

    Rows are numbered and written first, and found again by their number; texts are shuffled once.
    """
    number, times, one = fresh(docs, "uid", "times", "one")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    sizes = rows.select(quoted(number).alias("uid"), *_drawn(docs, key, text, source))
    chosen = taken(stored(sizes, "mix-sizes")).where("times > 0").select(
        F.col("uid").alias(number), F.col("times").cast("int").alias(times)
    )
    rows = rows.join(stored(chosen, "mix-times"), number)
    rows = rows.withColumn(one, F.explode(F.array_repeat(F.lit(1), quoted(times))))
    return rows.select(*map(quoted, docs.columns))
