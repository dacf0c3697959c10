"""Seen: which keys are new, without meeting all keys that were ever seen.

A crawl's keys are kept as a bitmap: every key sets the bit of its hash. Bitmaps of crawls add up by "or", and
all of them together have a fixed number of bits, whatever number of keys was seen. A key whose bit is
not set is new; the others are looked up exactly, among those seen keys that have the bit of one of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.sources.shared import stored

#: Bits of all bitmaps together: 8 MB. With a tenth of them set, nine of ten new keys need no look-up.
BITS = 1 << 26
#: Bits of one bitmap, as Spark makes them.
SLOT = 1 << 15


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def seen_sketch(keys: DataFrame, key: str = "page_key", bits: int = BITS) -> DataFrame:
    """(slot, marks) of the keys; at most ``bits / 8`` bytes. Null keys leave no mark."""
    place = _place(key, bits)
    marked = keys.where(F.col(key).isNotNull()).select(
        F.floor(place / SLOT).alias("slot"), (place % SLOT).alias("at")
    )
    return marked.groupBy("slot").agg(F.bitmap_construct_agg("at").alias("marks"))


def merged_sketch(sketches: DataFrame) -> DataFrame:
    """One sketch of many."""
    return sketches.groupBy("slot").agg(F.bitmap_or_agg("marks").alias("marks"))


def marked_keys(rows: DataFrame, sketch: DataFrame, key: str = "page_key", bits: int = BITS) -> DataFrame:
    """``rows`` with ``marked``: false only if the sketch has not seen the key; null keys are never marked.

    The sketch is broadcast; ``bits`` bounds its size.
    """
    place = _place(key, bits)
    slots = F.broadcast(sketch.select(F.col("slot").alias("_slot"), "marks"))
    at = place % SLOT
    byte = F.conv(F.hex(F.substring("marks", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, _bit)").bitwiseAND(1) == 1
    found = rows.join(slots, F.floor(place / SLOT) == F.col("_slot"), "left")
    found = found.withColumns({"_byte": byte, "_bit": (at % 8).cast("int")})
    marked = F.col(key).isNotNull() & F.coalesce(bit, F.lit(False))
    return found.withColumn("marked", marked).drop("_slot", "marks", "_byte", "_bit")


def new_by_sketch(
    roles: DataFrame, seen: DataFrame, sketch: DataFrame, key: str = "page_key", bits: int = BITS
) -> DataFrame:
    """What ``new_roles`` gives: roles whose key is not among the seen keys; a role without a key is new.

    ``sketch`` is that of ``seen``. Seen keys are read, but only those that share a bit with a key that may have
    been seen are shuffled: the shuffle grows with the crawl, not with what was seen before.
    """
    told = stored(marked_keys(roles, sketch, key, bits), "marked")
    rest = told.where("marked").drop("marked")
    asked = seen_sketch(rest, key, bits)
    candidates = marked_keys(seen.select(key), asked, key, bits).where("marked").select(key).distinct()
    return told.where("NOT marked").drop("marked").unionByName(rest.join(candidates, key, "left_anti"))
