"""Watch queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators import (
    merged_sketch,
    new_by_sketch,
    new_roles,
    own_content,
    page_fields,
    page_key,
    page_roles,
    seen_sketch,
    site_activity,
    snapshot_diff,
    top_roles,
)
from jobtrail.plans import inputs
from jobtrail.plans.score import ITEMS, K, TOP, keywords_of, pairs_of, scored
from jobtrail.sources import new_folder, outbox_sink, read_batches, read_outbox, scan_pages, spread, stored, write_batch
from jobtrail.streaming import new_keys, run_to_end


#: Parts in which streams get a table.
PARTS = 3


def current(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.current_pages(scan_pages(spark, folder))


def fields(spark: SparkSession, folder: str) -> DataFrame:
    return page_fields(inputs.crawled(spark, folder))


def keys(spark: SparkSession, folder: str) -> DataFrame:
    return page_key(scan_pages(spark, folder)).select("page_id", "host", "path", "page_key")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    return page_roles(inputs.crawled(spark, folder))


def diff(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_diff(inputs.previous_pages(spark, folder), current(spark, folder))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    return site_activity(diff(spark, folder))


def unseen(spark: SparkSession, folder: str) -> DataFrame:
    found = page_key(current(spark, folder)).select("page_id", "page_key")
    return new_roles(found, page_key(inputs.previous_pages(spark, folder))).select("page_id", "page_key")


def unseen_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The pages arrive in parts by id, each in one file in order; those that are read again show nothing new."""
    inbox = new_folder(spark, "pages")
    # Keys need the address only. All tasks read; the one that writes a part gets no html.
    pages = scan_pages(spark, folder).select("page_id", "url")
    for part in range(PARTS):
        arrived = pages.where(F.pmod("page_id", F.lit(PARTS)) == part)
        arrived.repartition(1).sortWithinPartitions("page_id").write.mode("append").parquet(inbox)
    seen = stored(page_key(inputs.previous_pages(spark, folder)).select("page_key").distinct(), "seen-keys")
    out = new_folder(spark, "new-roles")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    arriving = page_key(inputs.now_there(stream))
    run_to_end(new_keys(arriving, seen), outbox_sink(f"{out}/keys"), f"{out}/checkpoint")
    return read_outbox(spark, f"{out}/keys", "page_id bigint, url string, page_key string, batch bigint").drop("batch")


def unseen_by_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """``unseen`` by bitmaps; what was seen came in two crawls, each with a sketch of its own."""
    seen = stored(page_key(inputs.previous_pages(spark, folder)).select("page_id", "page_key"), "seen-keys")
    sketches = new_folder(spark, "sketches")
    for crawl in range(2):
        part = seen_sketch(seen.where(F.pmod("page_id", F.lit(2)) == crawl))
        write_batch(sketches, crawl, spark, lambda out, part=part: part.write.parquet(out))
    sketch = stored(merged_sketch(read_batches(spark, sketches, "slot bigint, marks binary, batch bigint")), "sketch")
    found = page_key(current(spark, folder)).select("page_id", "page_key")
    return new_by_sketch(found, seen, sketch).select("page_id", "page_key")


def role_diff(spark: SparkSession, folder: str) -> DataFrame:
    """``diff`` of what is the pages' own."""
    before = own_content(spread(inputs.previous_pages(spark, folder), "page_id"))
    now = own_content(spread(current(spark, folder), "page_id"))
    return snapshot_diff(before, now)


def new_role_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The new pages as roles: the id of the page and its reading text."""
    # Ids and keys alone find the new pages; their html is then read where it lies.
    ids = stored(unseen(spark, folder).select("page_id").distinct(), "new-pages")
    new_pages = current(spark, folder).join(ids, "page_id", "left_semi")
    return page_fields(new_pages).selectExpr(
        "page_id AS role_id", "body AS text", "language AS lang", "CAST(length(body) AS BIGINT) AS n_chars"
    )


def top_new(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of the new pages for each search."""
    roles = stored(new_role_texts(spark, folder), "new-role-texts")
    return top_roles(scored(roles, inputs.items(spark, folder)), K)


QUERIES = {
    "scan_pages": scan_pages,
    "page_fields": fields,
    "page_roles": listed,
    "page_key": keys,
    "snapshot_diff": diff,
    "site_activity": activity,
    "new_roles": unseen,
    "new_roles_stream": unseen_stream,
    "new_roles_by_sketch": unseen_by_sketch,
    "role_diff": role_diff,
    "top_new_roles": top_new,
}

_CRAWLS = """
    prev AS (SELECT page_id, url, html FROM pages WHERE NOT ends_with(url, '?utm_source=feed')),
    cur AS (SELECT page_id, url,
                   html || CASE WHEN starts_with(url, 'http:') THEN '<p>moved</p>' ELSE '' END AS html
            FROM pages WHERE NOT ends_with(url, '#top'))"""

_FIELDS = """
    [x for x in string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')
     if x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')]"""
_KEY = f"""
    regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^(www|m)\\.', '')
    || regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '(/|\\.html)$', '')
    || CASE WHEN len({_FIELDS}) > 0 THEN '?' || array_to_string({_FIELDS}, '&') ELSE '' END"""

_DIFF = f"""{_CRAWLS},
    diff AS (
        SELECT coalesce(c.page_id, p.page_id) AS page_id, coalesce(c.url, p.url) AS url,
               CASE WHEN p.page_id IS NULL THEN 'added' WHEN c.page_id IS NULL THEN 'removed'
                    WHEN md5(p.html) <> md5(c.html) THEN 'changed' ELSE 'same' END AS state
        FROM prev p FULL OUTER JOIN cur c ON p.page_id = c.page_id)"""


def _read(markup: str) -> str:
    """SQL for the reading text of a piece of markup."""
    text = f"regexp_replace({markup}, '<[^>]*>', ' ', 'g')"
    for name, sign in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"),
        ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
    ):
        text = f"replace({text}, '{name}', '{sign}')"
    return f"trim(regexp_replace({text}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_UNREAD = (
    "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>"
)
_LANGUAGE = """(?is)<html\\b[^>]*?\\blang\\s*=\\s*["'']?([a-z0-9-]+)"""
_HEADING = _read("regexp_extract(markup, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_BODY = _read(
    """CASE WHEN markup LIKE '%<article%'
       THEN regexp_extract(markup, '(?is)<article[^>]*>(.*?)</article>', 1) ELSE markup END"""
)

_UNSEEN = f"""{_CRAWLS},
    unseen AS (SELECT page_id, html, {_KEY} AS page_key FROM cur
               WHERE {_KEY} NOT IN (SELECT {_KEY} FROM prev))"""

NEW_TEXTS = f"""{_UNSEEN},
    read AS (SELECT page_id, lower(regexp_extract(html, '{_LANGUAGE}', 1)) AS lang,
                    regexp_replace(html, '{_UNREAD}', ' ', 'g') AS markup FROM unseen),
    roles AS (SELECT page_id AS role_id, lang, {_BODY} AS text, CAST(length({_BODY}) AS BIGINT) AS n_chars FROM read)"""


def _own(crawl: str) -> str:
    """SQL for the lines of a crawl's pages that are not the site's."""
    return f"""
    pieces_{crawl} AS (
        SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
               [x for x in [trim(regexp_replace(y, '[ \\t\\r\\n\\f]+', ' ', 'g')) for y in
                   regexp_split_to_array(regexp_replace(html, '{_UNREAD}', ' ', 'g'), '<[^>]*>')] if x <> ''] AS lines
        FROM {crawl}),
    site_{crawl} AS (
        SELECT host, line FROM (
            SELECT host, line, count(*) AS n FROM (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM pieces_{crawl}) GROUP BY 1, 2)
        JOIN (SELECT host, count(*) AS pages FROM pieces_{crawl} GROUP BY 1) USING (host)
        WHERE n >= 3 AND n >= 0.5 * pages),
    sites_{crawl} AS (SELECT host, list(line) AS gone FROM site_{crawl} GROUP BY 1),
    own_{crawl} AS (
        SELECT page_id, url, [x for x in lines if NOT list_contains(coalesce(gone, []), x)] AS own
        FROM pieces_{crawl} LEFT JOIN sites_{crawl} USING (host))"""


ORACLES = {
    "scan_pages": "SELECT page_id, url, html FROM pages",
    "page_fields": f"""
        WITH read AS (
            SELECT page_id, lower(regexp_extract(html, '{_LANGUAGE}', 1)) AS language,
                   regexp_replace(html, '{_UNREAD}', ' ', 'g') AS markup
            FROM pages)
        SELECT page_id, language, {_HEADING} AS heading, {_BODY} AS body FROM read""",
    "page_roles": f"""
        WITH read AS (
            SELECT page_id, lower(regexp_extract(html, '{_LANGUAGE}', 1)) AS language,
                   regexp_replace(html, '{_UNREAD}', ' ', 'g') AS markup
            FROM pages)
        SELECT page_id, CAST(0 AS INTEGER) AS position, language, {_HEADING} AS heading, {_BODY} AS body FROM read""",
    "page_key": f"""
        SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
               regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, {_KEY} AS page_key
        FROM pages""",
    "snapshot_diff": f"WITH {_DIFF} SELECT page_id, url, state FROM diff",
    "site_activity": f"""
        WITH {_DIFF}
        SELECT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
               count(CASE WHEN state = 'added' THEN 1 END) AS added,
               count(CASE WHEN state = 'removed' THEN 1 END) AS removed,
               count(CASE WHEN state = 'changed' THEN 1 END) AS changed,
               count(CASE WHEN state = 'same' THEN 1 END) AS same
        FROM diff GROUP BY 1""",
    "new_roles": f"WITH {_UNSEEN} SELECT page_id, page_key FROM unseen",
    "new_roles_stream": f"""
        WITH {_UNSEEN}
        SELECT page_id, url, page_key FROM unseen JOIN cur USING (page_id)
        QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY page_id % {PARTS}, page_id) = 1""",
    "new_roles_by_sketch": f"WITH {_UNSEEN} SELECT page_id, page_key FROM unseen",
    "role_diff": f"""
        WITH {_CRAWLS}, {_own("prev")}, {_own("cur")},
        diff AS (
            SELECT coalesce(c.page_id, p.page_id) AS page_id, coalesce(c.url, p.url) AS url,
                   CASE WHEN p.page_id IS NULL THEN 'added' WHEN c.page_id IS NULL THEN 'removed'
                        WHEN p.own <> c.own THEN 'changed' ELSE 'same' END AS state
            FROM own_prev p FULL OUTER JOIN own_cur c ON p.page_id = c.page_id)
        SELECT page_id, url, state FROM diff""",
    "top_new_roles": f"WITH {NEW_TEXTS}, {ITEMS}, {pairs_of('roles', 'role_id')}, {keywords_of('roles', 'role_id')} {TOP.format(scores='kw', k=K)}",
}
