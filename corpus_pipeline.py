"""From raw documents to token ids, in stages that each write a table the next one reads.

Every stage is a function of (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame with the columns of ``documents``; the last one returns ids instead of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm import content_sort, cube, jaccard, merges, perplexity
from jobtrail.llm.common import fresh, quoted, read
from jobtrail.llm.queries import vocabulary
from jobtrail.sources.shared import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like the trusted ones of their language."""
    return perplexity.accepted(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return content_sort.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by shared shingles."""
    # Ids may repeat or be null, so rows are numbered; the numbers are written, or they might change.
    number, least = fresh(docs, "uid", "least")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-rows")
    found = stored(jaccard.similar_documents(rows, key=number), "near-components")
    ids = rows.select(quoted(number), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", quoted(number)).alias(least))
    groups = found.join(ids, number).groupBy("component_id").agg(F.min(least).alias(least))
    kept = groups.select(F.col(least)[number].alias(number))
    # Copies are fewer than documents: Spark broadcasts their numbers if the written table is small.
    copies = stored(found.select(number).join(kept, number, "left_anti"), "near-copies")
    return rows.join(copies, number, "left_anti").select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks for: not at all, or up to three times."""
    return cube.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts, with whether decoding them gives the text again."""
    tables = merges.load(vocabulary("piece_bpe_32k.model"))
    ids, number, whole = fresh(docs, "ids", "n_tokens", "whole")
    done = merges.encode_checked(docs, tables, "text", ids, whole)
    return done.withColumn(number, F.size(ids))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL expresses neither the language model nor the merges; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
