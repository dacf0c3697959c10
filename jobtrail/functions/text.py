"""Column expressions over plain text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is an unbroken run of letters of any script.
WORD_PATTERN = r"\p{L}+"


def words(text: Column) -> Column:
    """All words of a text, lower-cased, in reading order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def distinct_words(text: Column) -> Column:
    """Each word of a text once."""
    return F.array_distinct(words(text))
