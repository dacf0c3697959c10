"""Score queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators import (
    blend_scores,
    cell_bounds,
    deal_cells,
    fit_centres,
    keyword_score,
    keyword_weights,
    nearest,
    posting_weights,
    preference_filter,
    probe,
    search_roles,
    top_roles,
    units,
    vector_score,
)
from jobtrail.plans import inputs
from jobtrail.sources import add_postings, new_folder, read_postings, stored, stored_by

K = 10
#: Batches in which roles are indexed.
BATCHES = 2
W_KEYWORDS = 0.7
W_VECTORS = 0.3


def _probed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(searches, index, bounds, found): the roles whose id 20 divides search all roles."""
    directions = stored(units(inputs.role_vectors(spark, folder)), "directions")
    centres = stored(fit_centres(directions), "centres")
    index = stored_by(deal_cells(directions, centres), "cells", "cell")
    bounds = stored(cell_bounds(index, centres), "bounds")
    searches = directions.where("role_id % 20 = 0")
    return searches, index, bounds, probe(searches, index, bounds, K)


def nearest_probed(spark: SparkSession, folder: str) -> DataFrame:
    return _probed(spark, folder)[-1]


def nearest_roles(spark: SparkSession, folder: str) -> DataFrame:
    searches, index, bounds, found = _probed(spark, folder)
    return nearest(searches, index, bounds, stored(found, "probed"), K)


def wanted(spark: SparkSession, folder: str) -> DataFrame:
    return _wanted(spark, folder, inputs.items(spark, folder))


def _wanted(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    return preference_filter(inputs.roles(spark, folder), inputs.preferences(items))


def scored(roles: DataFrame, items: DataFrame) -> DataFrame:
    """Keyword scores of the roles each search's preferences allow."""
    prefs = stored(inputs.preferences(items), "preferences")
    weights = stored(keyword_weights(roles, inputs.profiles(items)), "weights")
    return keyword_score(roles, prefs, weights)


def by_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return scored(inputs.texts(spark, folder), inputs.items(spark, folder))


def by_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _by_vectors(spark, folder, inputs.items(spark, folder))


def _by_vectors(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    return vector_score(
        _wanted(spark, folder, items),
        inputs.role_vectors(spark, folder),
        inputs.profile_vectors(spark, folder, items),
    )


def vectors_rounded(spark: SparkSession, folder: str) -> DataFrame:
    return by_vectors(spark, folder).selectExpr("profile_id", "role_id", "round(score, 6) AS score")


def blended(spark: SparkSession, folder: str) -> DataFrame:
    items = inputs.items(spark, folder)
    kw = stored(scored(inputs.texts(spark, folder), items), "keyword-scores")
    return blend_scores(kw, _by_vectors(spark, folder, items), W_KEYWORDS, W_VECTORS)


def top(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best roles for each search."""
    return top_roles(by_keywords(spark, folder), K)


def indexed(spark: SparkSession, folder: str) -> str:
    """The folder of the postings of all roles, which came in batches."""
    index = new_folder(spark, "postings")
    for batch in range(BATCHES):
        arrived = inputs.texts(spark, folder).where(F.pmod("role_id", F.lit(BATCHES)) == batch)
        add_postings(arrived, index, batch)
    return index


def top_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """``top`` from stored postings."""
    roles, blocks = read_postings(spark, indexed(spark, folder))
    items = inputs.items(spark, folder)
    prefs = stored(inputs.preferences(items), "preferences")
    weights = stored(posting_weights(roles, blocks, inputs.profiles(items)), "weights")
    return search_roles(blocks, prefs, weights, K)


def top_blended(spark: SparkSession, folder: str) -> DataFrame:
    return top_roles(blended(spark, folder), K)


QUERIES = {
    "preference_filter": wanted,
    "keyword_score": by_keywords,
    "nearest_roles": nearest_roles,
    "vector_score": vectors_rounded,
    "blend_scores": blended,
    "top_roles": top,
    "search_roles": top_indexed,
    "top_blended_roles": top_blended,
}

ITEMS = """
    items AS (SELECT b.item_id, b.text, d.lang, d.n_chars FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"""

PREFS = """
    prefs AS (SELECT lang AS profile_id, lang, CAST(sum(n_chars) // (2 * count(*)) AS BIGINT) AS min_chars,
                     CAST(2 * sum(n_chars) // count(*) AS BIGINT) AS max_chars
              FROM items GROUP BY lang)"""


def pairs_of(table: str, key: str) -> str:
    """SQL for the roles of a table that preferences allow."""
    return f"""{PREFS},
    pairs AS (SELECT p.profile_id, t.{key} AS role_id
              FROM prefs p JOIN {table} t
                ON t.lang = p.lang AND t.n_chars BETWEEN p.min_chars AND p.max_chars)"""


_PAIRS = pairs_of("documents", "doc_id")


def keywords_of(table: str, key: str) -> str:
    """SQL for keyword scores of the texts of a table, of whose roles ``pairs`` are wanted."""
    return f"""
    wishes AS (SELECT DISTINCT lang AS profile_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word
               FROM items),
    spoken AS (SELECT {key} AS role_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word
               FROM {table}),
    tf AS (SELECT role_id, word, count(*) AS tf FROM spoken GROUP BY 1, 2),
    weights AS (SELECT word, CAST(round(ln(((SELECT count(*) FROM {table}) + 1) / (count(*) + 1)) * 1000000) AS BIGINT) AS weight
                FROM tf GROUP BY 1),
    kw AS (SELECT profile_id, role_id, CAST(sum(tf * weight) AS DOUBLE) / 1000000 AS score
           FROM tf JOIN weights USING (word) JOIN wishes USING (word) JOIN pairs USING (profile_id, role_id)
           GROUP BY 1, 2)"""


KEYWORDS = keywords_of("documents", "doc_id")
WANTED = f"{ITEMS}, {_PAIRS}, {KEYWORDS}"

_VECTORS = """
    vec AS (SELECT p.profile_id, p.role_id,
                   avg(list_inner_product(CAST(r.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[]))) AS score
            FROM pairs p JOIN embeddings r ON r.vec_id = p.role_id
                         JOIN items ON items.lang = p.profile_id JOIN embeddings w ON w.vec_id = items.item_id
            GROUP BY 1, 2)"""

_BLEND = """
    top AS (SELECT profile_id, max(score) AS top FROM kw GROUP BY 1),
    blend AS (SELECT profile_id, role_id,
                     round(0.7::DOUBLE * coalesce(k.score / nullif(t.top, 0), 0) + 0.3::DOUBLE * coalesce(v.score, 0), 6) AS score
              FROM kw k FULL JOIN vec v USING (profile_id, role_id) LEFT JOIN top t USING (profile_id))"""

TOP = """
    SELECT profile_id, CAST(rank AS INTEGER) AS rank, role_id, score FROM (
        SELECT profile_id, role_id, round(score, 6) AS score,
               row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 6) DESC, role_id) AS rank
        FROM {scores})
    WHERE rank <= {k}"""

_ALL = f"{ITEMS}, {_PAIRS}, {KEYWORDS}, {_VECTORS}, {_BLEND}"

ORACLES = {
    "preference_filter": f"WITH {ITEMS}, {_PAIRS} SELECT profile_id, role_id FROM pairs",
    "keyword_score": f"WITH {ITEMS}, {_PAIRS}, {KEYWORDS} SELECT profile_id, role_id, score FROM kw",
    "nearest_roles": f"""WITH known AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        units AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM known),
        pairs AS (
            SELECT a.vec_id AS search_id, b.vec_id AS role_id, round(list_dot_product(a.e, b.e), 9) AS score
            FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0)
        SELECT search_id, role_id, score,
            CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, role_id) AS INTEGER) AS rank
        FROM pairs QUALIFY rank <= {K}""",
    "vector_score": f"""WITH {ITEMS}, {_PAIRS}, {_VECTORS}
        SELECT profile_id, role_id, round(score, 6) AS score FROM vec""",
    "blend_scores": f"WITH {_ALL} SELECT profile_id, role_id, score FROM blend",
    "search_roles": f"WITH {ITEMS}, {_PAIRS}, {KEYWORDS} {TOP.format(scores='kw', k=K)}",
    "top_roles": f"WITH {ITEMS}, {_PAIRS}, {KEYWORDS} {TOP.format(scores='kw', k=K)}",
    "top_blended_roles": f"WITH {_ALL} {TOP.format(scores='blend', k=K)}",
}
