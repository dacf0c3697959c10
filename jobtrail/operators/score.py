"""Score: how well roles fit what a profile is looking for."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions import distinct_words, words

# Word weights are whole millionths: their sums are exact, whatever the order of adding up.
UNIT = 1_000_000
DIGITS = 6


def preference_filter(roles: DataFrame, prefs: DataFrame) -> DataFrame:
    """(profile, role) pairs in the wanted language and within the wanted length."""
    pairs = roles.join(prefs, "lang")
    return pairs.where(F.col("n_chars").between(F.col("min_chars"), F.col("max_chars"))).select(
        "profile_id", "role_id"
    )


def keyword_weights(roles: DataFrame, profiles: DataFrame) -> DataFrame:
    """``ln((N + 1) / (df + 1))`` of each word of a profile that occurs in ``df`` of the N roles."""
    wishes = profiles.select(
        "profile_id", F.explode(distinct_words(F.col("text"))).alias("word")
    ).distinct()
    spread = roles.select(F.explode(distinct_words(F.col("text"))).alias("word"))
    found = spread.join(wishes.select("word").distinct(), "word", "left_semi")
    found = found.groupBy("word").agg(F.count("*").alias("df"))
    n = roles.agg(F.count("*")).scalar()
    weight = F.round(F.ln((n + 1) / (F.col("df") + 1)) * UNIT).cast("bigint")
    return wishes.join(found, "word").select("profile_id", "word", weight.alias("weight"))


def keyword_score(roles: DataFrame, prefs: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum over shared words of ``tf * weight`` for the roles that a profile's preferences allow.

    A role meets only profiles of its language that want its length. Texts stay where they
    are read: their words meet the weights, which are a lookup, and are added up before the
    shuffle. Hand in stored preferences and weights, whose size Spark then knows.
    """
    wanted = weights.join(prefs, "profile_id")
    said = roles.select("role_id", "lang", "n_chars", F.explode(words(F.col("text"))).alias("word"))
    shared = said.join(wanted, ["lang", "word"])
    shared = shared.where(F.col("n_chars").between(F.col("min_chars"), F.col("max_chars")))
    return shared.groupBy("profile_id", "role_id").agg((F.sum("weight") / UNIT).alias("score"))


def vector_score(pairs: DataFrame, role_vectors: DataFrame, profile_vectors: DataFrame) -> DataFrame:
    """Mean dot product, in double, of a role's vector with the vectors of a profile.

    Scoring takes the pairs that met the hard preferences, so both joins are on keys. The mean of
    the dot products is the dot product with the mean vector, whose components are added up before
    the shuffle: no row holds more than one vector of a profile. A missing component, also
    that of a shorter vector, gives a null score.
    """
    given = profile_vectors.where("embedding IS NOT NULL")
    parts = given.select("profile_id", F.posexplode_outer("embedding").alias("at", "x"))
    parts = parts.groupBy("profile_id", "at").agg(
        F.count("*").alias("n"), F.count("x").alias("known"), F.avg(F.col("x").cast("double")).alias("x")
    )
    # One row per profile and component; a vector without components has its place before the others.
    place = F.struct(F.coalesce("at", F.lit(-1)).alias("at"), F.when(F.col("n") == F.col("known"), F.col("x")).alias("x"), "n")
    wishes = parts.groupBy("profile_id").agg(F.array_sort(F.collect_list(place)).alias("parts"), F.max("n").alias("items"))
    wish = F.transform("parts", lambda part: F.when(part["n"] == F.col("items"), part["x"]))
    wishes = wishes.select("profile_id", wish.alias("wish"))
    both = pairs.join(role_vectors, "role_id").join(wishes, "profile_id")
    products = F.zip_with("embedding", "wish", lambda a, b: a.cast("double") * b)
    total = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return both.select("profile_id", "role_id", total.alias("score"))


def blend_scores(kw: DataFrame, vec: DataFrame, w_kw: float, w_vec: float) -> DataFrame:
    """``w_kw * kw / max(kw) of the profile + w_vec * vec``; a missing part counts 0.

    The maxima are grouped first and joined back: a window per profile would sort all of a
    profile's roles in one task. ``kw`` is read more than once, so hand in a stored table.
    """
    kw = kw.select("profile_id", "role_id", F.col("score").alias("kw"))
    vec = vec.select("profile_id", "role_id", F.col("score").alias("vec"))
    top = kw.groupBy("profile_id").agg(F.max("kw").alias("top"))
    both = kw.join(vec, ["profile_id", "role_id"], "full_outer")
    scaled = both.join(top, "profile_id", "left")
    kw_part = F.coalesce(F.try_divide(F.col("kw"), F.col("top")), F.lit(0.0))
    blend = w_kw * kw_part + w_vec * F.coalesce("vec", F.lit(0.0))
    return scaled.select("profile_id", "role_id", F.round(blend, DIGITS).alias("score"))


def top_roles(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` roles per profile, equal scores ordered by role id.

    The filter stands right on ``row_number``, so each task keeps only its own best ``k``
    rows of a profile before the shuffle.
    """
    score = F.round("score", DIGITS)
    best = Window.partitionBy("profile_id").orderBy(score.desc(), F.col("role_id"))
    return (
        scores.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("profile_id", "rank", "role_id", score.alias("score"))
    )
