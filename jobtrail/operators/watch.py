"""Watch: what stands on a career page, what changed between two crawls, which roles are new."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.functions import address_key, host_of, markup_text, path_of
from jobtrail.functions.pages import SPACE, TAG, UNREAD, element
from jobtrail.sources.shared import stored

OPEN = r"(?i:<article\b[^>]*>)"
CLOSE = r"(?i:</article\s*>)"


def page_fields(pages: DataFrame) -> DataFrame:
    """Heading, language and reading text of each page.

    Scripts, styles, comments and the head go first, since they may hold text that looks like
    tags. The text runs from the first ``article`` to the end of the last, to the end of the page if
    one is not closed, and is the whole page where there is none.
    """
    read = _read(pages)
    markup = F.col("markup")
    opened, closed = (F.regexp_count(markup, F.lit(tag)) for tag in (OPEN, CLOSE))
    rest = F.regexp_extract(markup, rf"(?s){OPEN}(.*)", 1)
    body = (
        F.when(opened == 0, markup)
        .when(opened > closed, rest)
        .otherwise(F.regexp_extract(rest, rf"(?s)(.*){CLOSE}", 1))
    )
    return read.select(
        "page_id", markup_text(element(markup, "h1")).alias("heading"), "language", markup_text(body).alias("body")
    )


def page_roles(pages: DataFrame) -> DataFrame:
    """The roles a page lists: one for each ``article``, numbered from 0, or the whole page.

    An article ends at its closing tag or where the next one opens.
    """
    markup = F.col("markup")
    parts = F.split(markup, OPEN, -1)
    listed = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    roles = _read(pages).select("page_id", "language", F.posexplode(listed).alias("position", "part"))
    part = F.regexp_replace(F.col("part"), rf"(?s){CLOSE}.*", "")
    return roles.select(
        "page_id",
        "position",
        "language",
        markup_text(element(F.col("part"), "h1")).alias("heading"),
        markup_text(part).alias("body"),
    )


def _read(pages: DataFrame) -> DataFrame:
    """Language and markup of pages, without the parts that are not read."""
    html = F.col("html")
    language = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z0-9-]+)""", 1)
    return pages.select(
        "page_id",
        F.lower(language).alias("language"),
        F.regexp_replace(html, F.lit(UNREAD), F.lit(" ")).alias("markup"),
    )


def page_key(pages: DataFrame) -> DataFrame:
    """Add host, path and a key shared by all spellings of the address."""
    url = F.col("url")
    parsed = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    return parsed.withColumn("page_key", address_key(F.col("path"), url))


def snapshot_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """State of every page seen in either crawl: added, removed, changed or same.

    The html is hashed where it is read. Both crawls then go through one grouping, which folds
    repeated copies of a page before the shuffle and needs no join. Should a crawl hold several
    versions of a page, the one with the greatest hash stands for it.
    """

    def versions(pages: DataFrame, crawl: str) -> DataFrame:
        content = F.coalesce(F.md5(F.col("html").cast("binary")), F.lit(""))
        return pages.select(
            "page_id",
            F.struct(content.alias("content"), "url").alias("version"),
            F.lit(crawl).alias("crawl"),
        )

    def version_in(crawl: str):
        return F.max(F.when(F.col("crawl") == crawl, F.col("version"))).alias(crawl)

    both = versions(prev, "prev").unionByName(versions(cur, "cur"))
    state = (
        F.when(F.col("prev").isNull(), "added")
        .when(F.col("cur").isNull(), "removed")
        .when(F.col("prev.content") != F.col("cur.content"), "changed")
        .otherwise("same")
    )
    return (
        both.groupBy("page_id")
        .agg(version_in("prev"), version_in("cur"))
        .select("page_id", F.coalesce("cur.url", "prev.url").alias("url"), state.alias("state"))
    )


def site_activity(diff: DataFrame) -> DataFrame:
    """Pages added, removed, changed and unchanged per host."""
    counts = [
        F.count(F.when(F.col("state") == state, 1)).alias(state)
        for state in ("added", "removed", "changed", "same")
    ]
    return diff.groupBy(host_of(F.col("url")).alias("host")).agg(*counts)


def new_roles(roles: DataFrame, seen: DataFrame, key: str = "page_key") -> DataFrame:
    """Roles whose key is not among the seen keys. A role without a key is new.

    Hand in ids and keys only: what is large is joined back for the few that are new.
    """
    return roles.join(seen.select(key).distinct(), key, "left_anti")


#: A line belongs to the site if it stands on this share of a host's pages, and on so many at least.
SITE_SHARE, SITE_PAGES = 0.5, 3


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, lines): the hashes of a page's pieces of text between tags, in order, without empty ones."""
    markup = F.regexp_replace("html", F.lit(UNREAD), F.lit(" "))
    pieces = F.transform(F.split(markup, TAG), lambda piece: F.trim(F.regexp_replace(piece, F.lit(SPACE), F.lit(" "))))
    lines = F.transform(F.filter(pieces, lambda piece: piece != ""), lambda piece: F.xxhash64(piece))
    return pages.select(
        "page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce(lines, F.array().cast("array<bigint>")).alias("lines")
    )


def site_lines(read: DataFrame, share: float = SITE_SHARE, least: int = SITE_PAGES) -> DataFrame:
    """(host, line) of ``page_lines``: what stands on most pages of a host, such as menus and footers.

    Counts are by host and line, so a host with very many pages is no single group.
    """
    on = read.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    on = on.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sizes = read.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"))
    both = on.join(sizes, F.col("host").eqNullSafe(F.col("of")))
    return both.where(F.col("n") >= share * F.col("pages")).select("host", "line")


def own_content(pages: DataFrame, share: float = SITE_SHARE, least: int = SITE_PAGES) -> DataFrame:
    """(page_id, url, html): pages with a digest of their own lines, those that are not the site's, in place of
    the html. ``snapshot_diff`` of two crawls in this form tells apart roles that changed from sites that changed a footer."""
    read = stored(page_lines(pages), "page-lines")
    site = stored(site_lines(read, share, least), "site-lines").withColumnsRenamed({"host": "of", "line": "site_line"})
    rows = read.select("page_id", "url", "host", F.posexplode_outer("lines").alias("at", "line"))
    same = F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("site_line"))
    # A page all of whose lines are the site's still has a row.
    own = rows.join(site, same, "left").withColumn("own", F.when(F.col("site_line").isNull(), F.struct("at", "line")))
    own = own.groupBy("page_id", "url").agg(F.array_sort(F.collect_list("own")).alias("own"))
    digest = F.array_join(F.transform("own", lambda x: x["line"].cast("string")), " ")
    return own.select("page_id", "url", F.md5(digest.cast("binary")).alias("html"))
