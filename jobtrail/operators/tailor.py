"""Tailor: choose and order existing resume fragments for each role.

All choices start from ``matched_words``: one row per role with the numbers of those of its words
that a fragment has. It reads each text once and shuffles one row per role. What follows is counted
by role, where that row already lies, so rows per role and fragment, or per role and word, are never shuffled.
Matches that were stored are dealt by role once more (``by_role``), to tasks of a fixed size.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions import distinct_words
from jobtrail.sources.shared import stored
from jobtrail.sources.tables import dealt

#: Bytes of stored matches that one task counts: some thousands of roles, each with a row per fragment.
EACH = 1 << 18


def fragment_words(fragments: DataFrame) -> DataFrame:
    """(word, number, fragment_id) of the distinct words of each fragment; every word has a number."""
    lines = fragments.select("fragment_id", F.explode(distinct_words(F.col("text"))).alias("word")).distinct()
    lines = stored(lines, "fragment-lines")
    numbers = lines.select("word").distinct().withColumn("number", F.monotonically_increasing_id())
    return stored(lines.join(stored(numbers, "word-numbers"), "word").select("word", "number", "fragment_id"), "fragment-words")


def matched_words(roles: DataFrame, lines: DataFrame) -> DataFrame:
    """(role_id, needed, said) of every role: how many distinct words it has, and the numbers of those in ``lines``
    (``fragment_words``). Repeated roles with one id are one role, which says the words of all."""
    needs = roles.select("role_id", distinct_words(F.col("text")).alias("words"))
    needs = needs.withColumn("needed", F.coalesce(F.array_size("words"), F.lit(0)).cast("bigint"))
    # Words that no fragment has are left out at once; the empty one, which is no word, keeps each role.
    words = F.array_append(F.coalesce("words", F.array().cast("array<string>")), "")
    numbers = lines.select("word", "number").distinct()
    none = lines.sparkSession.sql("SELECT '' AS word, CAST(NULL AS BIGINT) AS number")
    said = needs.select("role_id", "needed", F.explode(words).alias("word")).join(numbers.unionByName(none), "word")
    # All words of a role are in one task, which folds them before the shuffle.
    return said.groupBy("role_id").agg(F.max("needed").alias("needed"), F.collect_set("number").alias("said"))


def by_role(matched: DataFrame) -> DataFrame:
    """Stored ``matched_words`` dealt by role. The rows per role and fragment that a task counts don't
    become more the more roles there are, and none of them is shuffled."""
    return dealt(matched, "role_id", EACH)


def _shared(matched: DataFrame, lines: DataFrame) -> DataFrame:
    """(role_id, number, fragment_id) for each word that a role and a fragment share."""
    return matched.select("role_id", F.explode("said").alias("number")).join(
        lines.select("number", "fragment_id"), "number"
    )


def rank_matched(matched: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """``rank_fragments`` of words that were matched before."""
    shared = _shared(matched, lines).groupBy("role_id", "fragment_id").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("role_id").orderBy(F.col("shared").desc(), "fragment_id")
    return (
        shared.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("role_id", "rank", "fragment_id", "shared")
    )


def rank_fragments(roles: DataFrame, fragments: DataFrame, k: int) -> DataFrame:
    """Best ``k`` fragments per role by distinct shared words, ties by fragment id."""
    lines = fragment_words(fragments)
    return rank_matched(by_role(stored(matched_words(roles, lines), "matched")), lines, k)


def cover_matched(matched: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """``cover_fragments`` of words that were matched before."""
    held = _shared(matched, lines).groupBy("role_id", "fragment_id").agg(F.collect_list("number").alias("words"))
    # At most one entry per fragment: as many as fragments share a word with the role.
    roles = held.groupBy("role_id").agg(F.collect_list(F.struct("fragment_id", "words")).alias("offers"))
    choice = "struct<covered: array<bigint>, chosen: array<struct<fragment_id: bigint, gained: bigint>>>"
    nothing = F.struct(F.array().alias("covered"), F.array().alias("chosen")).cast(choice)

    def step(so_far: Column, _: Column) -> Column:
        worth = F.transform(
            "offers",
            lambda offer: F.struct(
                F.size(F.array_except(offer["words"], so_far["covered"])).cast("bigint").alias("gained"),
                (-offer["fragment_id"]).alias("before"),
                offer["words"].alias("words"),
            ),
        )

        def take(best: Column) -> Column:
            taken = F.struct((-best["before"]).alias("fragment_id"), best["gained"].alias("gained"))
            more = F.struct(
                F.array_union(so_far["covered"], best["words"]).alias("covered"),
                F.array_append(so_far["chosen"], taken).alias("chosen"),
            )
            return F.when(best["gained"] > 0, more).otherwise(so_far)

        # The best offer stands in an array of one, so that it is worked out once.
        return F.get(F.transform(F.array(F.array_max(worth)), take), F.lit(0))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(k)), nothing, step)
    steps = roles.select("role_id", F.posexplode(fold["chosen"]).alias("place", "step"))
    return steps.select("role_id", (F.col("place") + 1).alias("rank"), "step.fragment_id", "step.gained")


def cover_fragments(roles: DataFrame, fragments: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` fragments per role that together cover many of its words: one after the other, each the one
    with the most words not covered yet, ties by fragment id, as long as one has any.

    ``rank_fragments`` may choose fragments that say the same; these complement one another. The choice is
    a fold over arrays, in the row of the role.
    """
    lines = fragment_words(fragments)
    return cover_matched(by_role(stored(matched_words(roles, lines), "matched")), lines, k)


def gap_matched(matched: DataFrame, chosen: DataFrame, lines: DataFrame) -> DataFrame:
    """``coverage_gap`` of words that were matched before."""
    words = lines.groupBy("fragment_id").agg(F.collect_list("number").alias("words"))
    held = chosen.select("role_id", "fragment_id").distinct().join(words, "fragment_id")
    held = held.groupBy("role_id").agg(F.flatten(F.collect_list("words")).alias("held"))
    both = F.coalesce(F.size(F.array_intersect("said", "held")), F.lit(0)).cast("bigint")
    # No intersection with null has a size of its own in every setting.
    covered = F.when(F.col("held").isNull(), F.lit(0).cast("bigint")).otherwise(both)
    return (
        matched.join(held, "role_id", "left")
        .select("role_id", "needed", covered.alias("covered"))
        .withColumn("missing", F.col("needed") - F.col("covered"))
    )


def coverage_gap(roles: DataFrame, chosen: DataFrame, fragments: DataFrame) -> DataFrame:
    """Distinct words of each role: needed, covered by its chosen fragments, and missing."""
    lines = fragment_words(fragments)
    return gap_matched(by_role(stored(matched_words(roles, lines), "matched")), chosen, lines)


def assemble_resume(roles: DataFrame, ranked: DataFrame, fragments: DataFrame) -> DataFrame:
    """One resume per role: its fragments in rank order, a blank line between them.

    A role with no fragment gets an empty resume. A list holds at most the ``k`` fragments
    that ranking left for a role.
    """
    texts = fragments.select("fragment_id", "text")
    lines = ranked.join(texts, "fragment_id")
    in_order = F.array_sort(F.collect_list(F.struct("rank", "text")))
    resumes = lines.groupBy("role_id").agg(
        F.array_join(F.transform(in_order, lambda line: line["text"]), "\n\n").alias("resume")
    )
    return roles.select("role_id").join(resumes, "role_id", "left").na.fill("", ["resume"])
