"""Watch, as pages arrive."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_keys(arriving: DataFrame, seen: DataFrame, key: str = "page_key") -> DataFrame:
    """(page_id, url, key) of the first page to arrive with each key that is not among the seen ones.

    ``arriving`` is a stream, ``seen`` a table of keys. Which keys have come is kept as state of the
    stream, so a micro-batch costs as much as what arrives in it and the lookup of its keys, however
    many batches there were. The state holds each new key for good, about a hundred bytes a key; a run that starts with
    a new checkpoint, and with the keys of the run before among the seen ones, starts with an empty one. Each page without a
    key is new, as it is for ``new_roles``.
    """
    pages = arriving.select("page_id", "url", key)
    keyless = pages.where(F.col(key).isNull())
    # Known keys go first, so that only new ones become state.
    first = pages.where(F.col(key).isNotNull()).join(seen.select(key), key, "left_anti")
    first = first.select("page_id", "url", key).dropDuplicates([key])
    return first.unionByName(keyless)
