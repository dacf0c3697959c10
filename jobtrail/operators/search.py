"""Search: the best roles from stored postings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions import distinct_words
from jobtrail.operators.score import UNIT, top_roles
from jobtrail.sources.shared import stored

#: Buckets per profile that are scored before any is skipped.
SEEDS = 8


def posting_weights(roles: DataFrame, blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """The weights that ``keyword_weights`` gives, from the numbers beside the blocks: no text is read."""
    wishes = profiles.select("profile_id", F.explode(distinct_words(F.col("text"))).alias("word")).distinct()
    found = blocks.select("word", "n").join(wishes.select("word").distinct(), "word", "left_semi")
    found = found.groupBy("word").agg(F.sum("n").alias("df"))
    n = roles.agg(F.count("*")).scalar()
    weight = F.round(F.ln((n + 1) / (F.col("df") + 1)) * UNIT).cast("bigint")
    return wishes.join(found, "word").select("profile_id", "word", weight.alias("weight"))


def bucket_bounds(blocks: DataFrame, prefs: DataFrame, weights: DataFrame) -> DataFrame:
    """(profile_id, batch, bucket, bound): no role of the bucket scores more, in units of the weights.

    Only buckets of the profile's language with a length it may want; ``weights`` and ``prefs`` are stored.
    """
    wanted = weights.join(prefs, "profile_id")
    heads = blocks.select("word", "batch", "bucket", "lang", "low", "high", "most").join(wanted, ["word", "lang"])
    heads = heads.where((F.col("high") >= F.col("min_chars")) & (F.col("low") <= F.col("max_chars")))
    bound = F.sum(F.col("most") * F.col("weight"))
    return heads.groupBy("profile_id", "batch", "bucket").agg(bound.alias("bound"))


def _scored(blocks: DataFrame, chosen: DataFrame, prefs: DataFrame, weights: DataFrame) -> DataFrame:
    """(profile_id, role_id, points) of the wanted roles of the ``chosen`` (profile_id, batch, bucket)."""
    wanted = weights.join(prefs, "profile_id").join(chosen, "profile_id")
    read = blocks.select("word", "batch", "bucket", "roles").join(
        wanted.select("profile_id", "word", "batch", "bucket", "weight", "min_chars", "max_chars"), ["word", "batch", "bucket"]
    )
    roles = read.select("profile_id", "weight", "min_chars", "max_chars", F.inline("roles"))
    roles = roles.where(F.col("n_chars").between(F.col("min_chars"), F.col("max_chars")))
    return roles.groupBy("profile_id", "role_id").agg(F.sum(F.col("tf") * F.col("weight")).alias("points"))


def search_roles(
    blocks: DataFrame, prefs: DataFrame, weights: DataFrame, k: int, seeds: int = SEEDS
) -> DataFrame:
    """Best ``k`` roles per profile, exactly as ``top_roles`` finds them by reading all texts.

    The ``seeds`` most promising buckets of each profile are scored. The worst of the best ``k`` roles found
    there is a score that others must reach, so buckets with a lower bound are never read. ``prefs``
    and ``weights`` are stored.
    """
    bounds = stored(bucket_bounds(blocks, prefs, weights), "bounds")
    first = Window.partitionBy("profile_id").orderBy(F.col("bound").desc(), "batch", "bucket")
    ranked = bounds.withColumn("place", F.row_number().over(first)).where(F.col("place") <= seeds)
    seeded = stored(ranked.select("profile_id", "batch", "bucket"), "seeds")
    known = stored(_scored(blocks, seeded, prefs, weights), "seed-scores")

    best = Window.partitionBy("profile_id").orderBy(F.col("points").desc())
    reach = known.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    reach = reach.groupBy("profile_id").agg(F.count("*").alias("n"), F.min("points").alias("least"))
    # A profile with fewer than k roles so far takes any.
    reach = stored(reach.where(F.col("n") == k).select("profile_id", "least"), "reach")
    left = bounds.join(seeded, ["profile_id", "batch", "bucket"], "left_anti").join(reach, "profile_id", "left")
    left = left.where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    left = stored(left.select("profile_id", "batch", "bucket"), "buckets")
    found = known.unionByName(_scored(blocks, left, prefs, weights))
    return top_roles(found.select("profile_id", "role_id", (F.col("points") / UNIT).alias("score")), k)
