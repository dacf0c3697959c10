"""Shards of even size that keep linked documents together (operator 3).

Balanced label propagation. Documents start in the shard of their id's hash. Every group of linked
documents adds up its bytes by shard, and the rounds then work on one row per group. In a round each group
without a place asks for the shard that holds most of it and has room for all of it. Requests meet quotas:
a shard takes the largest first, up to its room, which is what an even share leaves beside the groups
it took before; the others see the new rooms in the next round and ask again. Documents that still lie where their hash
put them take no room, as they will move too.

Groups larger than a share are laid first, groups that fit nowhere are laid last: one after the other along the
shards' rooms, so that each is cut in as few pieces as it needs. No shard thus gets more than its share of
linked documents, and documents without links even out the loads at no cost in cut links. Where they don't suffice,
documents of groups that are cut anyway move as well, and only then those of other groups laid last.

The law is ``bytes``: the sizes of the shards are near equal. Linked are documents with the same
text; other links can be given. Everything is DataFrame joins and aggregates; what comes
to the driver is one number per shard.

A null text has no bytes and is a text of its own. Rows repeated with their id are documents of their
own, and those alike in id and text stay together. Null ids are allowed. A text of any length is one document; one larger than a share
fills a shard alone. Other columns of the input, whatever their names, are not read. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import partitions, quoted
from jobtrail.sources.shared import stored

SHARDS = 24
#: Bytes a document takes besides its text.
FRAME = 8
#: No more rounds than this; rounds also end when no group found a place.
ROUNDS = 12
#: What chance adds to a group's choice, so that groups held alike by two shards don't all ask the same one.
CHANCE = 0.02
#: Requests are added up by size, in classes of half an octave, and by this many steps of a class.
REQUESTS = 128
#: Loads are evened out in steps of this part of a shard.
STEPS = 4096
#: Shards count as even when they differ by this part of the mean.
EVEN = 0.002
EVENINGS = 8
#: More documents may move when a turn leaves more than this part of the difference.
GAIN = 0.8


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = dict(rows.groupBy("shard").agg(F.sum("size")).collect())
    return [found.get(shard, 0) for shard in range(shards)]


def _by_shard(values: list, shard: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col(shard))


def _chance(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _up_to(*order: Column) -> Window:
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each group of two documents or more, with its bytes by shard."""
    cells = rows.where("group IS NOT NULL").groupBy("group", "shard")
    cells = cells.agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    # A group has one cell per shard at most.
    held = F.map_from_entries(F.collect_list(F.struct("shard", "held")))
    groups = cells.groupBy("group").agg(F.sum("n").alias("n"), F.sum("held").alias("bytes"), held.alias("held"))
    return groups.where("n > 1").select(
        "group", "bytes", "held",
        F.floor(2 * F.log2(F.greatest("bytes", F.lit(1)))).cast("int").alias("class"),
        F.pmod(F.xxhash64("group"), F.lit(REQUESTS)).cast("int").alias("step"),
        F.lit(None).cast("int").alias("goal"),
        F.lit(None).cast("double").alias("start"),
        F.lit(None).cast("double").alias("span"),
        F.lit(False).alias("cut"),
    )


def _settle(groups: DataFrame, rooms: list[float], mean: float, turn: int) -> DataFrame:
    """``groups`` in which those without a place asked for one, and shards took what they have room for."""
    room = F.array(*map(F.lit, rooms))

    def choice(shard: Column) -> Column:
        near = F.coalesce(F.element_at("held", shard), F.lit(0)) / F.greatest("bytes", F.lit(1))
        near = near + F.get(room, shard) / mean + CHANCE * _chance(F.col("group"), shard, F.lit(turn))
        return F.when(F.col("bytes") <= F.get(room, shard), F.struct(near.alias("score"), (-shard).alias("shard")))

    choices = F.transform(F.sequence(F.lit(0), F.lit(len(rooms) - 1)), choice)
    wish = F.when(F.expr("goal IS NULL AND start IS NULL"), -F.array_max(choices)["shard"])
    asked = groups.withColumn("wish", wish)
    wishes = asked.where("wish IS NOT NULL").groupBy("wish", "class", "step").agg(F.sum("bytes").alias("asked"))
    upto = F.sum("asked").over(_up_to(F.desc("class"), "step").partitionBy("wish"))
    taken = wishes.withColumn("upto", upto).where(F.col("upto") <= _by_shard(rooms, "wish"))
    # Shards, classes of a size and steps bound these rows, whatever the input.
    taken = F.broadcast(taken.select("wish", "class", "step", F.lit(True).alias("taken")))
    settled = asked.join(taken, ["wish", "class", "step"], "left")
    goal = F.when(F.col("taken"), F.col("wish")).otherwise(F.col("goal"))
    return settled.withColumn("goal", goal).select(groups.columns)


def _lay(groups: DataFrame, which: Column, ahead: float) -> DataFrame:
    """``groups`` in which those of ``which`` without a place have one on a line that begins at ``ahead``."""
    which = which & F.expr("goal IS NULL AND start IS NULL")
    laid = groups.where(which).groupBy("class", "step").agg(F.sum("bytes").alias("all"), F.count("*").alias("n"))
    upto = F.sum("all").over(_up_to(F.desc("class"), "step"))
    # Classes of a size and steps bound these rows.
    laid = F.broadcast(laid.withColumn("from", upto - F.col("all")))
    joined = groups.join(laid, ["class", "step"], "left")
    # A group alone in its step is cut where rooms end; of several, each is whole at a point of its own.
    point = F.col("from") + F.floor(F.col("all") * _chance(F.col("group")))
    alone = F.col("n") == 1
    start = F.when(which, ahead + F.when(alone, F.col("from")).otherwise(point))
    span = F.when(which, F.when(alone, F.col("all")).otherwise(0))
    return joined.withColumns(
        {
            "cut": F.when(which, alone).otherwise(F.col("cut")),
            "start": F.coalesce(start, "start").cast("double"),
            "span": F.coalesce(span, "span").cast("double"),
        }
    ).select(groups.columns)


def _ends(rooms: list[float], ahead: float) -> list[tuple[float, int]]:
    """Where each shard's room ends on the line that begins at ``ahead``, the largest room first."""
    ends = []
    for shard in sorted(range(len(rooms)), key=lambda shard: (-rooms[shard], shard)):
        ahead += rooms[shard]
        ends.append((ahead, shard))
    return ends


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (uid, group, size, shard) with new shards, and ``kind``: 0 without links, 1 of a group
    cut in pieces, 2 of a whole group laid last, 3 of a group that a shard took."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = max(1.0, total / shards)
    # Two lines: the rooms of all shards, for what is larger than one; the rooms left at the end.
    second = 2.0 * shards * mean
    rooms, whole = [mean] * shards, _ends([mean] * shards, 0.0)
    groups = stored(_lay(_groups(rows), F.col("bytes") > mean, 0.0), "shard-groups")
    sums = groups.agg(F.sum("bytes").alias("all"), F.sum("span").alias("laid")).first()
    waiting, left = sums["all"] or 0, sums.laid or 0.0
    waiting -= left
    for _, shard in whole:
        used = min(left, rooms[shard])
        rooms[shard] -= used
        left -= used
    free = rooms
    for turn in range(rounds):
        if waiting <= 0:
            break
        groups = stored(_settle(groups, rooms, mean, turn), "shard-settled")
        held = dict(groups.where("goal IS NOT NULL").groupBy("goal").agg(F.sum("bytes")).collect())
        rooms = [max(0.0, room - held.get(shard, 0)) for shard, room in enumerate(free)]
        before, waiting = waiting, (sums["all"] or 0) - (sums.laid or 0) - sum(held.values())
        if waiting >= before:
            break
    if waiting > 0:
        groups = stored(_lay(groups, F.lit(True), second), "shard-laid")
    ends = [F.struct(F.lit(end).alias("end"), F.lit(shard).alias("shard")) for end, shard in whole + _ends(rooms, second)]
    point = F.col("start") + F.col("span") * _chance(F.col("uid"))
    inside = F.filter(F.array(*ends), lambda room: point < room["end"])
    # Rounding may put a point at the very end.
    place = F.coalesce(F.get(inside, F.lit(0)), ends[-1])["shard"]
    placed = rows.join(groups.select("group", "goal", "start", "span", "cut"), "group", "left")
    laid = F.col("start").isNotNull()
    kind = F.when(F.col("goal").isNotNull(), 3).when(laid & F.col("cut"), 1).when(laid, 2).otherwise(0)
    shard = F.coalesce("goal", F.when(laid, place), "shard")
    return placed.withColumns({"kind": kind, "shard": shard}).drop("goal", "start", "span", "cut")


def even_out(rows: DataFrame, movable: Column, shards: int = SHARDS, turn: int = 0) -> DataFrame:
    """Move documents that may move from shards above the mean to those below it."""
    loads = _loads(rows, shards)
    mean = sum(loads) / shards
    excess = [max(0.0, load - mean) for load in loads]
    short = [max(0.0, mean - load) for load in loads]
    step = F.pmod(F.xxhash64("uid", F.lit(f"step {turn}")), F.lit(STEPS)).cast("int")
    rows = rows.withColumns({"movable": movable, "step": step})
    sizes = rows.where("movable").groupBy("shard", "step").agg(F.sum("size").alias("size"))
    sizes = sizes.where(_by_shard(excess, "shard") > 0)
    before = Window.partitionBy("shard").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("upto", F.sum("size").over(before))
    # A step goes if that brings the shard nearer to the mean: if half of it is in excess.
    sizes = sizes.where(F.col("upto") - F.col("size") / 2 < _by_shard(excess, "shard"))
    ahead = Window.orderBy("shard", "step").rowsBetween(Window.unboundedPreceding, 0)
    place = F.sum("size").over(ahead) - F.col("size") / 2
    goal, upto = F.lit(None).cast("int"), sum(short)
    last = max(range(shards), key=short.__getitem__)
    for shard in reversed(range(shards)):
        if short[shard]:
            goal = F.when(place < upto, F.lit(shard)).otherwise(goal)
            upto -= short[shard]
    # At most STEPS rows per shard, a bound that does not grow with the input.
    goes = F.broadcast(sizes.select("shard", "step", F.coalesce(goal, F.lit(last)).alias("goal")))
    rows = rows.join(goes, ["shard", "step"], "left")
    moved = F.when(F.col("movable") & F.col("goal").isNotNull(), F.col("goal")).otherwise(F.col("shard"))
    return rows.withColumn("shard", moved).drop("movable", "step", "goal")


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` with a gapless number from 0 inside each shard, without one task per shard."""
    parts = max(8, partitions(rows.sparkSession))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard and part: the number of shuffle partitions bounds it.
    sizes = F.broadcast(sizes.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n")))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "uid")) - 1
    rows = rows.withColumn("place", place).join(sizes, ["shard", "part"])
    return rows.withColumn("slot", (F.col("place") + F.col("n")).cast("long")).drop("part", "place", "n")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    body = quoted(text)
    rows = docs.select(
        quoted(key).alias("id"),
        # Draws and ties; rows that are alike in it are alike in all, so a rerun gives the same shards.
        F.xxhash64(quoted(key), body).alias("uid"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + FRAME).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit(""))).alias("text_crc32"),
        F.when(body.isNotNull(), F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))).alias(
            "group"
        ),
    )
    start = F.pmod(F.xxhash64(F.coalesce("id", "uid")), F.lit(shards)).cast("int")
    rows = stored(rows.withColumn("shard", start), "shard-rows")
    rows = stored(propagate(rows, shards).drop("group"), "shard-propagated")
    best, movable = None, 0
    for turn in range(EVENINGS + 1):
        loads = _loads(rows, shards)
        apart = max(loads) - min(loads)
        if best and apart > GAIN * best[0]:
            # These moves gave next to nothing, so more documents may move.
            movable += 1
        if best and apart > best[0]:
            apart, rows = best
        best = apart, rows
        if apart * shards <= EVEN * sum(loads) or movable > 2 or turn == EVENINGS:
            break
        rows = stored(even_out(rows, F.col("kind") <= movable, shards, turn), "shard-even")
    return slots(rows).select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
