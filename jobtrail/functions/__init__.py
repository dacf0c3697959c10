from jobtrail.functions.pages import address_key, host_of, markup_text, path_of
from jobtrail.functions.text import distinct_words, words
from jobtrail.functions.times import micros

__all__ = ["address_key", "distinct_words", "host_of", "markup_text", "micros", "path_of", "words"]
