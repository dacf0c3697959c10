"""Column expressions over page addresses and page markup."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities that are decoded. The ampersand comes last, so that text which
# spells out an entity ("&amp;lt;") is decoded once and not twice.
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&amp;", "&"),
]

# Parts of a page that hold no reading text.
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
TAG = r"<[^>]*>"
SPACE = r"[ \t\r\n\f]+"


def markup_text(markup: Column) -> Column:
    """Reading text of a piece of markup: no tags, entities decoded, spaces folded."""
    text = F.regexp_replace(markup, F.lit(TAG), F.lit(" "))
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, F.lit(SPACE), F.lit(" ")))


def element(markup: Column, tag: str) -> Column:
    """Inner markup of the first ``tag`` element; empty string where there is none."""
    return F.regexp_extract(markup, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def host_of(url: Column) -> Column:
    """Lower-cased host; null for an address that is not well formed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


# Parts of a query that say where a visitor came from, not which page it is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def address_key(path: Column, url: Column) -> Column:
    """One key for all spellings of a page address.

    Scheme, user, usual port, leading ``www.`` or ``m.``, ``.html``, a final slash, tracking
    fields of the query and fragments are left out. Other ports, other fields of the query
    and fragments that are routes (``#/``) tell pages apart. An address that is not well formed
    is its own key, so it is never lost.
    """
    site = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    site = F.regexp_replace(site, r"^.*@", "")
    usual = F.when(F.lower(url).startswith("https:"), ":443$").otherwise(":80$")
    site = F.regexp_replace(F.regexp_replace(site, usual, F.lit("")), r"^(www|m)\.", "")
    page = F.regexp_replace(path, r"(/|\.html)$", "")
    fields = F.split(F.try_parse_url(url, F.lit("QUERY")), "&")
    fields = F.filter(fields, lambda field: (field != "") & ~field.rlike(TRACKING))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&")))
    fragment = F.try_parse_url(url, F.lit("REF"))
    route = F.when(fragment.startswith("/"), F.concat(F.lit("#"), fragment))
    empty = F.lit("")
    known = F.concat(site, page, F.coalesce(query, empty), F.coalesce(route, empty))
    return F.coalesce(known, F.lower(F.trim(url)))
