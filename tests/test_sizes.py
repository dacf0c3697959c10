"""What a task or the shuffle takes, as tables grow."""

from collections import Counter

import pytest
import regex
from helpers import plan_of
from pyspark.sql import functions as F

from jobtrail import plans
from jobtrail.operators import by_role, cover_matched, fragment_words, gap_matched, matched_words, rank_matched, tailor
from jobtrail.plans import watch
from jobtrail.sources import add_postings, postings, read_postings, stored


postings_roles = "role_id bigint, lang string, n_chars bigint, text string"


@pytest.fixture
def matches(spark):
    def made(n):
        roles = spark.range(n).selectExpr("id AS role_id", "concat('a b c d w', char(97 + CAST(id % 20 AS INT))) AS text")
        lines = fragment_words(spark.createDataFrame([(1, "a b"), (2, "c wd we"), (3, "d a")], "fragment_id bigint, text string"))
        return stored(matched_words(roles, lines), "matched"), lines

    return made


@pytest.mark.parametrize("choose", [rank_matched, cover_matched])
def test_choices_from_stored_matches_shuffle_one_row_per_role(matches, choose):
    matched, lines = matches(300)
    dealt = by_role(matched)
    plan = plan_of(gap_matched(dealt, choose(dealt, lines, 2), lines))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(role_id" in line]
    # The matches themselves, on both sides of the join; nothing by role and fragment.
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_tasks_grow_with_the_roles(matches, monkeypatch):
    monkeypatch.setattr(tailor, "EACH", 1 << 12)
    few, many = (by_role(matches(n)[0]).withColumn("part", F.spark_partition_id()) for n in (4_000, 40_000))
    most = [df.groupBy("part").count().agg(F.max("count")).first()[0] for df in (few, many)]
    assert most[1] < 3 * most[0]


def test_plans_shuffle_no_rows_per_role_and_fragment(spark):
    for name in ("cover_fragments", "coverage_gap", "rank_fragments"):
        plan = plan_of(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Exchange hashpartitioning(role_id" in plan and "hashpartitioning(role_id#" in plan
        assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning(role_id" in line), name


def test_arriving_pages_carry_no_html(spark, tmp_path, monkeypatch):
    """Html in one task is as much as the pages are."""
    monkeypatch.setattr(watch, "new_folder", lambda _, purpose: str(tmp_path / purpose))
    watch.unseen_stream(spark, "/root/testdata/sf0.001")
    arrived = spark.read.parquet(str(tmp_path / "pages"))
    assert arrived.columns == ["page_id", "url"]
    assert arrived.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert len(arrived.inputFiles()) == watch.PARTS


def test_postings_are_shuffled_once(spark, tmp_path):
    """A row per role with its words; before, rows per role and word moved three times."""
    roles = spark.createDataFrame([(1, "en", 9, "b a b"), (1, "en", 9, "a"), (2, None, None, None), (3, "de", 4, "")], postings_roles)
    written = []
    write_batch = postings.write_batch
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(postings, "write_batch", lambda folder, batch, spark, write: written.append(write) or write_batch(folder, batch, spark, write))
        add_postings(roles, str(tmp_path), 0)
    frames = dict(zip(written[0].__code__.co_freevars, (cell.cell_contents for cell in written[0].__closure__)))
    plan = plan_of(frames["blocks"])
    assert [line.count("bucket") for line in plan.splitlines() if "Exchange hashpartitioning" in line] == [1]
    _, blocks = read_postings(spark, str(tmp_path))
    got = {row.word: (row.n, row.most, [tuple(role) for role in row.roles]) for row in blocks.collect()}
    assert got == {"a": (1, 2, [(1, 9, 2)]), "b": (1, 2, [(1, 9, 2)])}


def test_words_of_a_text_are_counted_where_it_lies(spark):
    texts = ["b a b", "", None, "x", "A a\u00c4 \u00e4", "1 2", "z " * 5 + "a"]
    found = spark.createDataFrame([(text,) for text in texts], "text string").select("text", postings._terms(F.col("text")).alias("terms"))
    for row in found.collect():
        want = Counter(regex.findall(r"\p{L}+", row.text.lower())) if row.text else {}
        assert {term.word: term.tf for term in row.terms} == want and len(row.terms) == len(want)
