"""Tailor queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators import (
    assemble_resume,
    by_role,
    cover_matched,
    fragment_words,
    gap_matched,
    matched_words,
    rank_fragments,
    rank_matched,
)
from jobtrail.plans import inputs, watch
from jobtrail.sources import stored

K = 3


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The three best fragments for each role."""
    return rank_fragments(inputs.texts(spark, folder), inputs.fragments(spark, folder), K)


def _matched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(matched, lines); texts are read once for all that is asked of them."""
    lines = fragment_words(inputs.fragments(spark, folder))
    return by_role(stored(matched_words(inputs.texts(spark, folder), lines), "matched")), lines


def gap(spark: SparkSession, folder: str) -> DataFrame:
    matched, lines = _matched(spark, folder)
    return gap_matched(matched, rank_matched(matched, lines, K), lines)


def covering(spark: SparkSession, folder: str) -> DataFrame:
    """Three fragments for each role that cover as many of its words together as the greedy choice does."""
    matched, lines = _matched(spark, folder)
    return cover_matched(matched, lines, K)


def choices(spark: SparkSession, folder: str) -> DataFrame:
    """Words that all roles need, and how many of them either way of choosing covers."""
    matched, lines = _matched(spark, folder)
    found = None
    for name, choose in (("ranked", rank_matched), ("covering", cover_matched)):
        gaps = gap_matched(matched, choose(matched, lines, K), lines)
        row = gaps.agg(F.sum("needed").alias("needed"), F.sum("covered").alias("covered"))
        row = row.select(F.lit(name).alias("choice"), "needed", "covered")
        found = row if found is None else found.unionByName(row)
    return found


def resumes(spark: SparkSession, folder: str) -> DataFrame:
    return assemble_resume(
        inputs.roles(spark, folder), ranked(spark, folder), inputs.fragments(spark, folder)
    )


def new_role_resumes(spark: SparkSession, folder: str) -> DataFrame:
    """A resume for each new page."""
    roles = stored(watch.new_role_texts(spark, folder), "new-role-texts")
    fragments = inputs.fragments(spark, folder)
    return assemble_resume(roles, rank_fragments(roles, fragments, K), fragments)


QUERIES = {
    "rank_fragments": ranked,
    "coverage_gap": gap,
    "cover_fragments": covering,
    "coverage_by_choice": choices,
    "assemble_resume": resumes,
    "new_role_resumes": new_role_resumes,
}


def ranked_of(table: str, key: str) -> str:
    """SQL for the best fragments for the texts of a table."""
    return f"""
    lines AS (SELECT DISTINCT item_id AS fragment_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word
              FROM benchmark),
    needs AS (SELECT DISTINCT {key} AS role_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word
              FROM {table}),
    shared AS (SELECT role_id, fragment_id, count(*) AS shared FROM needs JOIN lines USING (word) GROUP BY 1, 2),
    ranked AS (SELECT role_id, CAST(rank AS INTEGER) AS rank, fragment_id, shared FROM (
                   SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY shared DESC, fragment_id) AS rank
                   FROM shared) WHERE rank <= 3)"""


def resumes_of(table: str, key: str) -> str:
    return f"""{ranked_of(table, key)},
    lists AS (SELECT role_id, string_agg(b.text, chr(10) || chr(10) ORDER BY rank) AS resume
              FROM ranked JOIN benchmark b ON item_id = fragment_id GROUP BY 1),
    resumes AS (SELECT t.{key} AS role_id, coalesce(resume, '') AS resume
                FROM {table} t LEFT JOIN lists ON t.{key} = lists.role_id)"""


RANKED = ranked_of("documents", "doc_id")
RESUMES = resumes_of("documents", "doc_id")


def _step(n: int) -> str:
    """SQL for the greedy choice's ``n``-th fragment of each role."""
    return f"""
    left{n} AS (SELECT role_id, word FROM needs {"" if n == 1 else f"""WHERE (role_id, word) NOT IN (
        SELECT role_id, word FROM greedy{n - 1} JOIN lines USING (fragment_id))"""}),
    gains{n} AS (SELECT role_id, fragment_id, count(*) AS gained FROM left{n} JOIN lines USING (word) GROUP BY 1, 2),
    best{n} AS (SELECT * FROM gains{n} QUALIFY row_number() OVER (PARTITION BY role_id ORDER BY gained DESC, fragment_id) = 1),
    greedy{n} AS (SELECT role_id, {n} AS rank, fragment_id, gained FROM best{n}
                  {"" if n == 1 else f"UNION ALL SELECT * FROM greedy{n - 1}"})"""


GREEDY = ",".join(_step(n) for n in range(1, K + 1))


def _covered(choice: str, chosen: str) -> str:
    return f"""
        SELECT '{choice}' AS choice, (SELECT count(*) FROM needs) AS needed, count(*) AS covered
        FROM needs WHERE (role_id, word) IN (SELECT role_id, word FROM {chosen} JOIN lines USING (fragment_id))"""


ORACLES = {
    "cover_fragments": f"""
        WITH {RANKED}, {GREEDY}
        SELECT role_id, CAST(rank AS INTEGER) AS rank, fragment_id, gained FROM greedy{K}""",
    "coverage_by_choice": f"""
        WITH {RANKED}, {GREEDY} {_covered("ranked", "ranked")} UNION ALL {_covered("covering", f"greedy{K}")}""",
    "rank_fragments": f"WITH {RANKED} SELECT role_id, rank, fragment_id, shared FROM ranked",
    "coverage_gap": f"""
        WITH {RANKED},
        held AS (SELECT DISTINCT role_id, word FROM ranked JOIN lines USING (fragment_id)),
        need AS (SELECT role_id, count(*) AS needed FROM needs GROUP BY 1),
        cover AS (SELECT role_id, count(*) AS covered FROM needs JOIN held USING (role_id, word) GROUP BY 1)
        SELECT doc_id AS role_id, coalesce(needed, 0) AS needed, coalesce(covered, 0) AS covered,
               coalesce(needed, 0) - coalesce(covered, 0) AS missing
        FROM documents LEFT JOIN need ON need.role_id = doc_id LEFT JOIN cover ON cover.role_id = doc_id""",
    "assemble_resume": f"WITH {RESUMES} SELECT role_id, resume FROM resumes",
    "new_role_resumes": f"""WITH {watch.NEW_TEXTS}, {resumes_of("roles", "role_id")}
        SELECT role_id, resume FROM resumes""",
}
