import random
from collections import Counter

import pytest
import regex
from helpers import plan_of, rows

from jobtrail.operators import (
    assemble_resume,
    cover_fragments,
    coverage_gap,
    fragment_words,
    matched_words,
    rank_fragments,
    rank_matched,
)

ROLES = "role_id bigint, text string"
FRAGMENTS = "fragment_id bigint, text string"


def words(text):
    return set(regex.findall(r"\p{L}+", text.lower())) if text else set()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"] + ["the"] * 20
    roles = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(50)]
    roles += [(50, "Nothing in common"), (51, None), (52, "1 2 3")]
    fragments = [(i, " ".join(rng.choices(vocabulary, k=8))) for i in range(12)]
    return roles, fragments


def ranked_by_hand(roles, fragments, k):
    best = {}
    for role, text in roles:
        shared = [(len(words(text) & words(line)), fragment) for fragment, line in fragments]
        shared = sorted((-n, fragment) for n, fragment in shared if n)
        best[role] = [(fragment, -n) for n, fragment in shared[:k]]
    return best


def test_fragments_by_hand(spark, texts):
    roles, fragments = texts
    found = rank_fragments(
        spark.createDataFrame(roles, ROLES), spark.createDataFrame(fragments, FRAGMENTS), 3
    )
    got = {}
    for row in found.orderBy("role_id", "rank").collect():
        got.setdefault(row.role_id, []).append((row.fragment_id, row.shared))
    want = ranked_by_hand(roles, fragments, 3)
    assert got == {role: best for role, best in want.items() if best}


def test_one_row_per_role_is_shuffled(spark, texts):
    roles, fragments = texts
    lines = fragment_words(spark.createDataFrame(fragments, FRAGMENTS))
    plan = plan_of(rank_matched(matched_words(spark.createDataFrame(roles, ROLES), lines), lines, 3))
    # Folded to a row per role before the only exchange by role; none by role and fragment, or role and word.
    assert plan.count("Exchange hashpartitioning(role_id") == 1
    assert "partial_collect_set" in plan.split("Exchange hashpartitioning(role_id")[1].splitlines()[1]


def greedy_by_hand(text, fragments, k):
    left, found = words(text), []
    while len(found) < k:
        gained, fragment = max(((len(left & words(line)), -fragment) for fragment, line in fragments), default=(0, 0))
        if not gained:
            break
        found.append((-fragment, gained))
        left -= words(dict(fragments)[-fragment])
    return found


@pytest.mark.parametrize("k", [1, 3, 20])
def test_covering_fragments_by_hand(spark, texts, k):
    roles, fragments = texts
    found = cover_fragments(spark.createDataFrame(roles, ROLES), spark.createDataFrame(fragments, FRAGMENTS), k)
    got = {}
    for row in found.orderBy("role_id", "rank").collect():
        got.setdefault(row.role_id, []).append((row.fragment_id, row.gained))
    want = {role: greedy_by_hand(text, fragments, k) for role, text in roles}
    assert got == {role: best for role, best in want.items() if best}


def test_covering_fragments_complement_one_another(spark):
    roles = spark.createDataFrame([(1, "a b c d e f")], ROLES)
    fragments = spark.createDataFrame([(1, "a b c d"), (2, "a b c"), (3, "e"), (4, "x y"), (5, None)], FRAGMENTS)
    assert rows(rank_fragments(roles, fragments, 2), "rank", "fragment_id") == [(1, 1), (2, 2)]
    assert rows(cover_fragments(roles, fragments, 5), "rank", "fragment_id", "gained") == [(1, 1, 4), (2, 3, 1)]


def test_gap_and_resumes_by_hand(spark, texts):
    roles, fragments = texts
    role_table = spark.createDataFrame(roles, ROLES)
    fragment_table = spark.createDataFrame(fragments, FRAGMENTS)
    ranked = rank_fragments(role_table, fragment_table, 3)
    lines = dict(fragments)
    best = ranked_by_hand(roles, fragments, 3)

    gap = coverage_gap(role_table, ranked, fragment_table)
    want = []
    for role, text in roles:
        held = set().union(*(words(lines[fragment]) for fragment, _ in best[role]))
        covered = len(words(text) & held)
        want.append((role, len(words(text)), covered, len(words(text)) - covered))
    assert rows(gap, "role_id", "needed", "covered", "missing") == sorted(want, key=str)
    assert Counter(row.covered + row.missing == row.needed for row in gap.collect()) == {True: len(roles)}

    resumes = assemble_resume(role_table, ranked, fragment_table)
    want = [(role, "\n\n".join(lines[fragment] for fragment, _ in best[role])) for role, _ in roles]
    assert rows(resumes, "role_id", "resume") == sorted(want, key=str)


def test_ties_go_to_the_lower_fragment(spark):
    roles = spark.createDataFrame([(1, "a b c")], ROLES)
    fragments = spark.createDataFrame([(9, "a b"), (4, "b c"), (7, "c a"), (2, "a")], FRAGMENTS)
    found = rank_fragments(roles, fragments, 2)
    assert rows(found, "rank", "fragment_id", "shared") == [(1, 4, 2), (2, 7, 2)]
