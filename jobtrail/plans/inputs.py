"""The given tables in the part of job-search data.

Pages are a crawl of career pages, documents are roles, benchmark texts are profiles and
resume fragments, and events are the log, with the user as the application.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.sources import read_table, scan_pages, spread, stored

# Stages of an application, as the log spells them.
SENT = "signup"
ANSWER = "purchase"


def crawled(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, laid out for work on their html."""
    return spread(scan_pages(spark, folder), "page_id")


def previous_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The crawl before: pages announced by the feed were not there yet."""
    return scan_pages(spark, folder).where(~F.col("url").endswith("?utm_source=feed"))


def now_there(pages: DataFrame) -> DataFrame:
    """Pages at ``#top`` are gone by now."""
    return pages.where(~F.col("url").endswith("#top"))


def current_pages(pages: DataFrame) -> DataFrame:
    """The crawl now: pages at ``#top`` are gone, sites without https carry a new footer."""
    footer = F.when(F.col("url").startswith("http:"), "<p>moved</p>").otherwise("")
    return now_there(pages).withColumn("html", F.concat("html", footer))


def roles(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").withColumnRenamed("doc_id", "role_id")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Roles, laid out for work on their texts."""
    return spread(roles(spark, folder), "role_id")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts, each with the language and length of the role of its number.

    A written table, so Spark knows its size wherever it is joined.
    """
    texts = read_table(spark, folder, "benchmark")
    like = roles(spark, folder).select(F.col("role_id").alias("item_id"), "lang", "n_chars")
    return stored(texts.join(like, "item_id"), "items")


def profiles(items: DataFrame) -> DataFrame:
    """One search per language, which looks for the words of all its benchmark texts."""
    return items.select(F.col("lang").alias("profile_id"), "text")


def preferences(items: DataFrame) -> DataFrame:
    """Each search wants its language, and half to double the mean length of its items."""
    number, chars = F.count("*"), F.sum("n_chars")
    return (
        items.groupBy("lang")
        .agg(number.alias("items"), chars.alias("chars"))
        .selectExpr(
            "lang AS profile_id",
            "lang",
            "chars div (2 * items) AS min_chars",
            "(2 * chars) div items AS max_chars",
        )
    )


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").withColumnRenamed("item_id", "fragment_id")


def role_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return vectors.select(F.col("vec_id").alias("role_id"), "embedding")


def profile_vectors(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """The vectors of all items of each search."""
    wished = items.select(F.col("lang").alias("profile_id"), F.col("item_id").alias("role_id"))
    return role_vectors(spark, folder).join(wished, "role_id").select("profile_id", "embedding")


def as_log(events: DataFrame) -> DataFrame:
    return events.withColumnsRenamed({"user_id": "application_id", "event_type": "status"})


def log(spark: SparkSession, folder: str) -> DataFrame:
    return as_log(read_table(spark, folder, "events"))


def applied(spark: SparkSession, folder: str) -> DataFrame:
    """Roles an application was sent for."""
    sent = log(spark, folder).where(F.col("status") == SENT)
    return sent.select(F.col("application_id").alias("role_id"))


def channels(spark: SparkSession) -> DataFrame:
    """Sources that take applications by mail."""
    return spark.sql("SELECT * FROM VALUES ('src1', 'email'), ('src2', 'email') AS t (source, channel)")


def shown(ts: str) -> Column:
    """A time as text to the microsecond, the same in every engine and session zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
