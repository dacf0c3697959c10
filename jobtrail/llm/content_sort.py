"""Exact duplicates by sorting the texts themselves (operator 7).

White space is deleted from every text. Range partitioning with splitters that Spark samples
from the normalised texts deals the rows out; an external sort inside each partition puts
equal texts next to each other; the window's comparisons of neighbouring whole texts find
the groups. The sampled key is the head of the normalised text and a hash of all of it: the sample
the driver holds is small however long the texts are, and texts with a common head spread.

A text with many copies would make one range too large. Texts are counted by hash first. A
hash with more than a quarter of a mean range's rows is hot; there are at most four times as
many of those as ranges, which bounds what is broadcast. The texts of hot rows don't move:
only (key, length, digest) are kept of them, and folded in each task before they meet.

Texts are equal when they are the same without white space. A null text counts as empty, and
empty texts equal each other. Of equal texts the one with the most code points before
normalising stays, then the one with the smallest key (a null key after all others). Rows repeated with
their key count as rows, and one of them stays. An empty table gives an empty table. Extra
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import WHITE, fresh, hex_digest, partitions, quoted
from jobtrail.sources.shared import stored

HEAD = 32
#: Ranges of fewer rows than this are not worth a special path for copies.
LEAST_RANGE = 64


def _normal(text: str) -> Column:
    return F.regexp_replace(F.coalesce(quoted(text), F.lit("")), WHITE, "")


def _size(text: str) -> Column:
    return F.length(F.coalesce(quoted(text), F.lit("")))


def _hot_hashes(docs: DataFrame, text: str) -> DataFrame:
    ranges = partitions(docs.sparkSession)
    mean = max(docs.count() / ranges, LEAST_RANGE)
    counts = docs.select(F.xxhash64(_normal(text)).alias("code")).groupBy("code").count()
    return stored(counts.where(F.col("count") > mean / 4).select("code"), "hot-hashes")


def _hot_rows(docs: DataFrame, hot: DataFrame, key: str, text: str) -> DataFrame:
    """(key, uid, text_sha256, keep_uid, keep_id, group_size) of the rows with a hot text."""
    rows = docs.select(
        quoted(key).alias("key"), _size(text).alias("size"), _normal(text).alias("norm")
    ).withColumn("code", F.xxhash64("norm"))
    rows = rows.join(F.broadcast(hot), "code", "left_semi").select(
        "key", "size", hex_digest(F.col("norm")).alias("text_sha256"), F.monotonically_increasing_id().alias("uid")
    )
    rows = stored(rows, "hot-rows")
    place = F.struct(-F.col("size"), F.col("key").isNull(), "key", "uid")
    groups = rows.groupBy("text_sha256").agg(
        F.min_by(F.struct("key", "uid"), place).alias("keep"), F.count("*").alias("group_size")
    )
    groups = groups.select(
        "text_sha256", F.col("keep.uid").alias("keep_uid"), F.col("keep.key").alias("keep_id"), "group_size"
    )
    return rows.join(F.broadcast(groups), "text_sha256")


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    hot = _hot_hashes(docs, text)
    rows = docs.select(
        quoted(key).alias("key"), _size(text).alias("size"), _normal(text).alias("norm")
    ).withColumns({"head": F.substring("norm", 1, HEAD), "code": F.xxhash64("norm")})
    sorted_rows = rows.join(F.broadcast(hot), "code", "left_anti").repartitionByRange("head", "code")
    equal = Window.partitionBy("head", "code", "norm")
    best = equal.orderBy(F.col("size").desc(), F.col("key").asc_nulls_last())
    found = sorted_rows.select(
        "key",
        F.first("key").over(best).alias("keep_id"),
        F.count("*").over(equal).alias("group_size"),
        (F.row_number().over(best) == 1).alias("kept"),
        hex_digest(F.col("norm")).alias("text_sha256"),
    )
    if not hot.isEmpty():
        copies = _hot_rows(docs, hot, key, text)
        kept = F.col("uid") == F.col("keep_uid")
        found = found.unionByName(
            copies.select("key", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
        )
    return found.withColumnRenamed("key", key)


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    hot = _hot_hashes(docs, text)
    code, head, norm, order, sha = fresh(docs, "code", "head", "norm", "order", "sha")
    hot = hot.withColumnRenamed("code", code)
    rows = docs.withColumn(code, F.xxhash64(_normal(text)))
    cold = rows.join(F.broadcast(hot), code, "left_anti")
    cold = cold.withColumn(head, F.substring(_normal(text), 1, HEAD)).repartitionByRange(head, code)
    best = Window.partitionBy(head, code, norm).orderBy(_size(text).desc(), quoted(key).asc_nulls_last())
    cold = cold.withColumn(norm, _normal(text)).withColumn(order, F.row_number().over(best))
    kept = cold.where(F.col(order) == 1).select(*map(quoted, docs.columns))
    if hot.isEmpty():
        return kept

    copies = _hot_rows(docs, hot.withColumnRenamed(code, "code"), key, text)
    stay = copies.where("uid = keep_uid").select(F.col("text_sha256").alias(sha), F.col("key").alias(order))
    large = rows.join(F.broadcast(hot), code, "left_semi").withColumn(sha, hex_digest(_normal(text)))
    same = large[sha].eqNullSafe(stay[sha]) & quoted(key).eqNullSafe(stay[order])
    large = large.join(F.broadcast(stay), same, "left_semi")
    one = Window.partitionBy(sha).orderBy(_size(text).desc())
    large = large.withColumn(order, F.row_number().over(one)).where(F.col(order) == 1)
    return kept.unionByName(large.select(*map(quoted, docs.columns)))
