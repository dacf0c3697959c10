import math
import random
from collections import Counter

import pytest
import regex
from helpers import plan_of, rows

from jobtrail import plans
from jobtrail.operators import (
    blend_scores,
    keyword_score,
    keyword_weights,
    preference_filter,
    top_roles,
    vector_score,
)

SCORES = "profile_id bigint, role_id bigint, score double"


def words(text):
    return regex.findall(r"\p{L}+", text.lower()) if text else []


def keyword_by_hand(roles, profiles, prefs):
    """Scores in millionths."""
    df = Counter(word for _, text, *_ in roles for word in set(words(text)))
    scores = Counter()
    for profile, wish in {(p, word) for p, text in profiles for word in words(text)}:
        _, lang, least, most = next(pref for pref in prefs if pref[0] == profile)
        for role, text, spoken, n_chars in roles:
            tf = words(text).count(wish)
            if tf and spoken == lang and least <= n_chars <= most:
                weight = math.log((len(roles) + 1) / (df[wish] + 1))
                scores[profile, role] += tf * round(weight * 1e6)
    return {pair: total / 1e6 for pair, total in scores.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["the"] * 30 + [f"{a}{b}é" for a in "abcd" for b in "xyz"] + ["Straße", "ÉCOLE"]
    roles = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    roles += [(60, None), (61, "12 34 ..."), (62, "The, the-THE\nthe")]
    roles = [(i, text, rng.choice(("de", "fr", None)), len(text or "")) for i, text in roles]
    profiles = [(1, "the Straße axé"), (1, "axé the école"), (2, "byé"), (3, "nothing shared"), (4, None)]
    prefs = [(1, "de", 0, 150), (2, "fr", 20, 999), (3, "fr", 0, 999), (4, "de", 0, 999)]
    return roles, profiles, prefs


def scores_of(spark, roles, profiles, prefs):
    roles = spark.createDataFrame(roles, "role_id bigint, text string, lang string, n_chars bigint")
    profiles = spark.createDataFrame(profiles, "profile_id bigint, text string")
    prefs = spark.createDataFrame(prefs, "profile_id bigint, lang string, min_chars bigint, max_chars bigint")
    return keyword_score(roles, prefs, keyword_weights(roles, profiles))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_keyword_score_by_hand(spark, corpus, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", broadcast)
    try:
        found = scores_of(spark, *corpus).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert {(row.profile_id, row.role_id): row.score for row in found} == keyword_by_hand(*corpus)


@pytest.mark.parametrize("name", ["keyword_score", "top_roles", "top_blended_roles", "apply_queue", "vector_score"])
def test_chain_keeps_to_preferences(spark, name):
    folder = "/root/testdata/sf0.01"
    wanted = plans.QUERIES["preference_filter"](spark, folder)
    found = plans.QUERIES[name](spark, folder)
    assert found.count() > 30
    assert found.join(wanted, ["profile_id", "role_id"], "left_anti").count() == 0


@pytest.mark.parametrize("name", ["keyword_score", "rank_fragments", "coverage_gap", "top_new_roles", "new_role_resumes"])
def test_no_text_is_shuffled(spark, name):
    """Only what the words are reduced to, apart from dealing a small table over the cores."""
    plan = plan_of(plans.QUERIES[name](spark, "/root/testdata/sf0.01"))
    for part in plan.split("Exchange hashpartitioning")[1:]:
        if "REPARTITION_BY_NUM" not in part.splitlines()[0]:
            below = part.splitlines()[1]
            assert "text#" not in below and "html#" not in below and "words#" not in below


def test_skewed_joins_are_split_at_run_time(spark):
    """A key of 90 % of the rows goes to more than 64 tasks, a key of 1 % to several."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "100",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows_ = spark.range(0, 400_000, 1, 100).selectExpr(
            "xxhash64(id) AS role_id", "CASE WHEN id % 10 > 0 THEN 'hot' WHEN id % 100 = 0 THEN 'warm' ELSE 'k' || id END AS lang",
            "5L AS n_chars",
        )
        prefs = spark.createDataFrame(
            [(1, "hot", 0, 9), (2, "warm", 0, 9)], "profile_id bigint, lang string, min_chars bigint, max_chars bigint"
        )
        found = preference_filter(rows_, prefs).selectExpr("profile_id", "role_id", "spark_partition_id() AS task")
        found = found.groupBy("profile_id").agg({"task": "approx_count_distinct", "role_id": "max"})
        tasks = {row.profile_id: row["approx_count_distinct(task)"] for row in found.collect()}
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert tasks[1] > 64 and tasks[2] > 1


def test_preferences(spark):
    roles = spark.createDataFrame(
        [(1, "en", 10), (2, "en", 20), (3, "en", 21), (4, "de", 15), (5, None, 15), (6, "en", None)],
        "role_id bigint, lang string, n_chars bigint",
    )
    prefs = spark.createDataFrame(
        [(1, "en", 10, 20), (2, "en", 20, 99), (3, "fr", 0, 99)],
        "profile_id int, lang string, min_chars int, max_chars int",
    )
    found = preference_filter(roles, prefs)
    assert rows(found, "profile_id", "role_id") == [(1, 1), (1, 2), (2, 2), (2, 3)]


def test_vector_score_gathers_no_vectors(spark):
    """Many items of one profile never meet in one cell, and the score is the mean of all dot products."""
    items = [("p", [float(i % 7), 1.0 / (i + 1), -float(i)]) for i in range(500)] + [("q", [1.0, 2.0, 3.0]), ("q", None)]
    items += [("short", [1.0, 2.0, 3.0]), ("short", [1.0, 2.0]), ("gap", [1.0, None, 3.0])]
    roles = [("r", [0.5, -2.0, 0.25]), ("s", [1.0, 0.0, 0.0])]
    wishes = spark.createDataFrame(items, "profile_id string, embedding array<float>")
    vectors = spark.createDataFrame(roles, "role_id string, embedding array<float>")
    pairs = wishes.select("profile_id").distinct().crossJoin(vectors.select("role_id"))
    found = vector_score(pairs, vectors, wishes)
    assert "collect_list(embedding" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(row.profile_id, row.role_id): row.score for row in found.collect()}
    for profile in ("p", "q"):
        for role, vector in roles:
            dots = [sum(a * b for a, b in zip(v, vector)) for key, v in items if key == profile and v]
            assert got[profile, role] == pytest.approx(sum(dots) / len(dots), rel=1e-6)
    assert [got[profile, role] for profile in ("short", "gap") for role in "rs"] == [None] * 4


def test_vector_score(spark):
    vectors = "{} bigint, embedding array<float>"
    pairs = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (2, 99)], "profile_id bigint, role_id bigint")
    roles = spark.createDataFrame([(10, [0.5, 0.25]), (11, [1.0, 0.0])], vectors.format("role_id"))
    wishes = [(1, [1.0, 2.0]), (2, [-1.0, 4.0]), (2, [-2.0, 8.0])]
    wishes = spark.createDataFrame(wishes, vectors.format("profile_id"))
    found = vector_score(pairs, roles, wishes)
    assert rows(found, "profile_id", "role_id", "score") == [(1, 10, 1.0), (2, 10, 0.75), (2, 11, -1.5)]


def test_blend_counts_a_missing_part_as_nothing(spark):
    kw = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (2, 10, 0.0)], SCORES)
    vec = spark.createDataFrame([(1, 11, 0.5), (1, 12, 1.0), (3, 10, 1.0)], SCORES)
    found = blend_scores(kw, vec, 0.7, 0.3)
    assert rows(found, "profile_id", "role_id", "score") == [
        (1, 10, 0.7), (1, 11, 0.5), (1, 12, 0.3), (2, 10, 0.0), (3, 10, 0.3),
    ]


def test_top_roles_breaks_ties_by_role(spark):
    scores = spark.createDataFrame(
        [(1, 5, 1.0), (1, 3, 1.0), (1, 4, 2.0), (1, 9, 0.5), (2, 7, 0.1)], SCORES
    )
    found = top_roles(scores, 3)
    assert rows(found, "profile_id", "rank", "role_id") == [(1, 1, 4), (1, 2, 3), (1, 3, 5), (2, 1, 7)]


def test_top_roles_are_thinned_before_the_shuffle(spark):
    scores = spark.createDataFrame([(1, 5, 1.0)], SCORES).repartition(4)
    before_shuffle = plan_of(top_roles(scores, 3)).split("Exchange hashpartitioning(profile_id")[1]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
