"""Stored postings: which roles say a word, and how often, kept in blocks that a search can skip.

Roles of a batch are dealt into buckets of roles of one language and about one length. For each word
and bucket there is one block: the roles with their counts, and beside them how many they are, the
largest count, and the span of lengths. A search reads the few numbers beside the blocks first, and blocks only of buckets
that may hold one of the best roles. Batches are added without reading those before.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions import words
from jobtrail.sources.commits import read_batches, write_batch
from jobtrail.sources.shared import stored

#: Roles of a bucket, about.
BUCKET = 256
#: Lengths of a bucket lie within one of so many parts of a doubling.
BANDS = 4
#: Characters of roles that a task makes blocks of, about.
EACH = 4 << 20

ROLES_SCHEMA = "role_id bigint, lang string, n_chars bigint, bucket bigint, batch bigint"
BLOCKS_SCHEMA = (
    "word string, bucket bigint, lang string, low bigint, high bigint, n bigint, most bigint, "
    "roles array<struct<role_id: bigint, n_chars: bigint, tf: bigint>>, batch bigint"
)


def _band() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)).cast("double")) * BANDS)


def _terms(text: Column) -> Column:
    """[(word, tf)] of a text: its words in order, cut where another word begins."""
    found = F.coalesce(F.array_sort(words(text)), F.array().cast("array<string>"))

    def counted(said: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(said)), lambda i: (i == 1) | (F.get(said, i - 1) != F.get(said, i - 2)))
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(said) + 1))
        return F.zip_with(
            begins, ends, lambda i, j: F.struct(F.get(said, i - 1).alias("word"), (j - i).cast("bigint").alias("tf"))
        )

    # In an array of one, so that words are found and sorted once.
    some = F.filter(F.array(found), lambda said: F.size(said) > 0)
    return F.flatten(F.transform(some, counted))


def add_postings(roles: DataFrame, folder: str, batch: int, bucket: int = BUCKET) -> None:
    """Index one batch of ``roles`` (role_id, lang, n_chars, text). The same batch again replaces itself.

    Texts stay where they are read: buckets follow from language, length and a hash of the id, and from
    how many roles there are of each. What is shuffled, once, is one row per role with its words and counts. Roles without a language or
    a length are counted, but no search finds them.
    """
    banded = roles.withColumn("band", _band())
    kinds = banded.groupBy("lang", "band").agg(
        F.ceil(F.count("*") / bucket).alias("buckets"), F.sum("n_chars").alias("chars")
    )
    kinds = stored(kinds.withColumnsRenamed({"lang": "of_lang", "band": "of_band"}), "bands")
    chars = kinds.agg(F.sum("chars")).first()[0] or 0
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("band").eqNullSafe(F.col("of_band"))
    slot = F.pmod(F.xxhash64("role_id"), F.col("buckets"))
    dealt = banded.join(kinds.drop("chars"), same).withColumn("bucket", F.xxhash64("lang", "band", slot))

    # One row per role moves, with each of its words once; roles of a bucket meet, and nothing moves after that.
    said = dealt.select("bucket", "lang", "role_id", "n_chars", _terms(F.col("text")).alias("terms"))
    tasks = max(roles.sparkSession.sparkContext.defaultParallelism, -(-chars // EACH))
    said = said.repartition(tasks, "bucket").select("bucket", "lang", "role_id", "n_chars", F.inline("terms"))
    # Rows with one id are one role.
    said = said.groupBy("bucket", "word", "lang", "role_id", "n_chars").agg(F.sum("tf").alias("tf"))
    blocks = said.groupBy("bucket", "word", "lang").agg(
        F.min("n_chars").alias("low"),
        F.max("n_chars").alias("high"),
        F.count("*").alias("n"),
        F.max("tf").alias("most"),
        F.collect_list(F.struct("role_id", "n_chars", "tf")).alias("roles"),
    )
    blocks = blocks.select("word", "bucket", "lang", "low", "high", "n", "most", "roles")
    ids = dealt.select("role_id", "lang", "n_chars", "bucket")

    def write(out: str) -> None:
        blocks.write.parquet(f"{out}/table=blocks")
        ids.write.parquet(f"{out}/table=roles")

    write_batch(folder, batch, roles.sparkSession, write)


def read_postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(roles, blocks) of all batches."""
    roles = read_batches(spark, folder, ROLES_SCHEMA, "roles")
    return roles, read_batches(spark, folder, BLOCKS_SCHEMA, "blocks")
