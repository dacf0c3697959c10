"""Spelling variant grouping by permuterm rotations (operator 12).

Words are marked with a terminator and all their rotations are sorted. In the rotation that ends with
the character at some place, that character can be skipped: what stands before it, text$text, is a
prefix that the rotations of all words differing there have in common, and that is the whole rotation
of the word without the character. So words that differ by a replacement are rows of one prefix, and
those that differ by an insertion are rows of a prefix and the row that is the prefix.

    cart, card   t$car, d$car  -> prefix $car of both        (replaced)
    cart, cat    $cart... r skipped: t$ca = rotation of cat  (inserted)

Rotations are dealt by ranges of their prefixes and sorted by Spark; a scan then meets each prefix
with all its rows, at most one for each letter there is, so no group grows with the input. The scan
emits two rows at most for each row it reads: how many words are near through this prefix, and
the most frequent one. Of a run of one letter only the first is skipped for insertions, so that each pair of words
meets exactly once.

A word's form is its most frequent near word, if that is at least twice as frequent. Forms at
least double from step to step, so following them ends after fewer than 63 steps; the steps are
doubled, too, so six joins are enough.

Occurrences are counted in all documents and over whole texts. A null text has no words. A null id is spelled as
nothing where the hash asks for it; rows that repeat, or share their id, count each for itself. Extra columns are not
looked at. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import quoted
from jobtrail.sources.shared import stored

RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
MARK = "$"
#: One run in so many of a document loses a character.
SPOILED = 97
SHORTEST, FEWEST = 5, 3
#: How often a form occurs for each time its variant does, at least.
DOMINANCE = 2
#: Words that a task counts before it hands its counts on.
HELD = 200_000


def spoken(key: object, text: str) -> Counter:
    """The words of a text, some of them spoiled, with their numbers."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    words: Counter = Counter()
    found = Counter(re.findall(RUN, text))
    lowered: Counter = Counter()
    for run, n in found.items():
        lowered[run.lower() if run.isascii() else run.translate(LOWER)] += n
    for run, n in lowered.items():
        draw = zlib.crc32(run.encode(), start)
        if draw % SPOILED == 0:
            place = draw % len(run)
            run = run[:place] + run[place + 1 :]
        if len(run) >= SHORTEST:
            words[run] += n
    return words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            if text.is_valid:
                held.update(spoken(key.as_py(), text.as_py()))
            if len(held) >= HELD:
                yield rows()
                held.clear()
    yield rows()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    rows = docs.select(quoted(key).alias("id"), quoted(text).alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= FEWEST)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, whole, first, n, word): every rotation of the marked words as it stands, and without its last
    character; ``first`` says that this character does not repeat the one before it in the word."""
    at, size = F.col("at"), F.length("word")
    rows = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    head = F.concat(F.lit(MARK), F.substring("word", F.lit(1), at))
    alike = (at > 0) & (F.substring("word", at, F.lit(1)) == F.substring("word", at + 1, F.lit(1)))

    def row(tail_from: Column, whole: bool, first: Column) -> Column:
        prefix = F.concat(F.substring("word", tail_from, size), head)
        return F.struct(prefix.alias("prefix"), F.lit(whole).alias("whole"), first.alias("first"))

    rotation = row(at + 1, True, F.lit(False))
    skipped = row(at + 2, False, ~alike)
    both = F.when(at < size, F.array(rotation, skipped)).otherwise(F.array(rotation))
    return rows.select(F.inline(both), "n", "word")


def _met(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """(word, near, best_n, best): what whole groups of sorted rows show; ``starts`` has their first rows."""
    n, whole, first = (rows.column(name).to_numpy(zero_copy_only=False) for name in ("n", "whole", "first"))
    place = np.arange(len(n))
    sizes = np.diff(np.append(starts, len(n)))
    start = np.repeat(starts, sizes)
    led = whole[start]
    skips = np.repeat(sizes, sizes) - led
    inserted = first & ~whole
    # Replaced: every other row of the prefix that skips a character; the rows are in order of worth.
    replaced = np.nonzero(~whole & (skips > 1))[0]
    top = start + led
    other = np.where(place == top, top + 1, top)[replaced]
    # Inserted: the word that is the prefix itself, and for that word all rows that skip.
    longer = np.nonzero(inserted & led)[0]
    number = np.add.reduceat(inserted.astype(np.int64), starts)
    best = np.minimum.reduceat(np.where(inserted, place, len(n)), starts)
    shorter = np.nonzero(whole[starts] & (number > 0))[0]

    at = np.concatenate([replaced, longer, starts[shorter]])
    by = np.concatenate([other, start[longer], best[shorter]])
    near = np.concatenate([skips[replaced] - 1, np.ones(len(longer), np.int64), number[shorter]])
    words = rows.column("word")
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(at)), pa.array(near.astype(np.int64)), pa.array(n[by]), words.take(pa.array(by))],
        ["word", "near", "best_n", "best"],
    )


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if not rows.num_rows:
            continue
        prefix = rows.column("prefix")
        turns = pa.compute.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.nonzero(turns)[0] + 1)
        # The last group may go on in the next batch.
        last = int(starts[-1])
        held = rows.slice(last)
        if last:
            yield _met(rows.slice(0, last), starts[:-1])
    if held is not None:
        yield _met(held, np.zeros(1, np.int64))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): the number of words near each, the most frequent of them, of those the
    smallest. Words near none are left out."""
    order = [F.col("prefix"), F.col("whole").desc(), F.col("n").desc(), F.col("word")]
    rows = rotations(words).repartitionByRange("prefix").sortWithinPartitions(*order)
    found = rows.mapInArrow(_scanned, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("top.less")).alias("form_n"), F.col("top.best").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each by ``forms`` (word, form)."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        steps = reached.join(onward, "root", "left")
        steps = stored(steps.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        reached = steps.select("word", "root")
        if steps.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(count_words(docs, key, text), "words")
    near = near_words(words)
    known = words.join(near, "word", "left")
    strong = F.col("form_n") >= DOMINANCE * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"),
    )
    known = stored(known, "near-words")
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
