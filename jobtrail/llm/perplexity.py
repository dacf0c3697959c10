"""Quality by perplexity under an n-gram model of trusted text (operator 5).

The model is interpolated modified Kneser-Ney of order 5 over characters as they are written: capitals, digits and signs
each for itself, up to U+02FF; others share 256 classes. A word that repeats one of the four words before it is one
sign of its own, so texts that say the same words again and again are unlikely too. Windows of five signs are counted in all
trusted texts; counts of shorter ones, discounts, context totals and the probabilities themselves, each from that of its
shorter window, are DataFrame aggregates and joins by context, stored order by order. They grow with
the input; a context is followed by at most 1024 signs, so no group does.

There are two models, one of each half of the trusted texts (by hash of the text), and a document is scored by the model of the other
half. So trusted texts are judged like any other text, by a model that has not seen them nor their copies.

Scoring is a join of the windows of all documents with the model. As a shuffled join it would move several times the
input (a text has about half as many different windows as signs); so the model is dealt into shards by the two
signs before the last one, where a window meets all that it backs off to, and each shard, of ``SHARD`` rows
at most (48 MB), is broadcast in a pass over the texts. Up to that size one pass is enough.

A document's score is its bits per sign, drawn towards its language's mean as if it had a few more
signs, since short texts vary widely. A second score takes only the signs at the edges of words, where order shows: a
full stop with a small letter after it, a capital in the middle of a sentence. A document is accepted up to a
high quantile of the trusted texts of its language plus a margin, in both scores. The fewer trusted texts a language
has, the more its quantile is drawn up towards a wider one: the language's own mean and ``WIDER`` times the distance that the
quantile of all texts has from the means of their languages. Languages without trusted texts and null ones use the
quantile of all.

Trusted are all documents with a label of quality 1. Their texts are written once; the counts and the
quantiles are taken from all of them. An empty or null text has no signs, its score is the mean, and it is accepted; a
very long one is scored in one piece. Without trusted texts nothing can be judged and all is accepted. Extra
columns, also with clashing names, stay as they are. Rows may repeat; repeated labels count once. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail.llm.common import fresh, map_rows, quoted
from jobtrail.operators.seen import marked_keys, seen_sketch
from jobtrail.sources.shared import stored

ORDER = 5
BITS = 10
SIGNS = 1 << BITS
#: Code points below this are signs; others share the rest of the signs.
PLAIN = 768
PAD, SPACE = 0, ord(" ")
#: The sign of a word that repeats one of the LOOK words before it: a control character.
REPEATED, LOOK = "\x01", 4
AGAIN = ord(REPEATED)
#: Where the half of a text stands above the code of a window.
HALF = ORDER * BITS
#: Rows of the model that are broadcast at a time.
SHARD = 4_000_000
#: A context leaves at least this to the shorter one.
LEAST = 2.0**-20
#: A language's quantile and the wider one weigh the same if it has so many trusted texts: of fewer
#: than 100, none need lie above the 0.99 quantile.
ENOUGH = 100
WIDER = 1.5
QUANTILE = 0.99
#: Bits per sign that a text may lie above the quantile, and signs of the mean that each text gets; of all signs and of
#: those at edges of words.
MARGIN, PRIOR = 0.3, 100
EDGE_MARGIN, EDGE_PRIOR = 0.1, 40
#: Characters that a task folds at a time, and windows that it holds before it hands counts on.
CHARS = 1 << 18
HELD = 1 << 20


def folded(text: str | None) -> str:
    """The text with single spaces, a sign in place of each word that was said just before."""
    words = (text or "").split()
    before = [[None] * back + words for back in range(1, LOOK + 1)]
    return "".join([REPEATED if word in near else " " + word for word, *near in zip(words, *before)])


def signs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, count): the window that ends at each sign of all texts, and the signs of each text."""
    lines = [folded(text) for text in texts]
    pads = "\0" * (ORDER - 1)
    points = np.frombuffer((pads + pads.join(lines)).encode("utf-32-le", "surrogatepass"), "<u4")
    sign = np.where(points < PLAIN, points, PLAIN + points % (SIGNS - PLAIN)).astype(np.int64)
    count = np.fromiter(map(len, lines), np.int64, len(lines))
    place = np.repeat(np.arange(1, len(count) + 1) * (ORDER - 1), count) + np.arange(count.sum())
    window = sign.copy()
    for back in range(1, ORDER):
        window[back:] |= sign[: len(sign) - back] << (BITS * back)
    return window[place], count


def at_edge(windows: np.ndarray) -> np.ndarray:
    """Which windows end with the first sign of a word, or with the sign that sets it off."""
    last, before = windows & (SIGNS - 1), (windows >> BITS) & (SIGNS - 1)
    return (before == SPACE) | (last == SPACE) | (last == AGAIN)


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    if len(sizes):
        group = (np.cumsum(sizes) - sizes) // CHARS
        cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(sizes)]])
        for start, stop in zip(cuts, cuts[1:]):
            yield slice(int(start), int(stop))


def _texts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[slice, list, np.ndarray]]:
    """Rows, texts and halves; column ``text`` has the texts and the last one the halves."""
    column = batch.column(text)
    halves = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy().astype(np.int64)
    for rows in _parts(sizes):
        yield rows, column.slice(rows.start, rows.stop - rows.start).to_pylist(), halves[rows]


def _half(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2))


def _windows(texts: list, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, place, count): the different windows with their text's half, which one each sign has, and the signs of each text."""
    windows, count = signs(texts)
    codes, place = np.unique(windows | np.repeat(halves.astype(np.int64), count) << HALF, return_inverse=True)
    return codes, place, count


def window_counts(docs: DataFrame, text: str) -> DataFrame:
    """(half, code, n): how often each window occurs in the texts of each half. Tasks add up before they hand on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(codes >> HALF), pa.array(codes & ((1 << HALF) - 1)), pa.array(counts)], ["half", "code", "n"]
            )

        for batch in batches:
            for _, texts, halves in _texts(batch, 0):
                found, place, _ = _windows(texts, halves)
                both = np.concatenate([codes, found])
                numbers = np.concatenate([counts, np.bincount(place, minlength=len(found))])
                codes, place = np.unique(both, return_inverse=True)
                counts = np.zeros(len(codes), np.int64)
                np.add.at(counts, place, numbers)
                if len(codes) > HELD:
                    yield rows()
                    codes, counts = codes[:0], counts[:0]
        yield rows()

    body = docs.select(quoted(text).alias("text"), _half(quoted(text)).alias("half"))
    found = body.mapInArrow(count, "half long, code long, n long")
    return found.groupBy("half", "code").agg(F.sum("n").alias("n"))


def _off(counts: DataFrame) -> Column:
    """What modified Kneser-Ney takes off counts of one, two, and three or more, for each half."""
    some = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    off = F.lit(0.5)
    for row in counts.groupBy("half").agg(*some).collect():
        n1, n2, n3, n4 = row.n1, row.n2, row.n3, row.n4
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            one, two, more = (float(min(max(d, 0.0), k)) for k, d in enumerate(raw, 1))
            own = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
            off = F.when(F.col("half") == row.half, own).otherwise(off)
    return off


def model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grams, contexts), stored, from the counts of windows: (half, size, code, bits) of every window of each size that
    was seen, and (half, size, code, left), the bits that a context of a window of that size costs on the way to the shorter one.

    The window ``code`` of a size has ``size`` signs, its context one less.
    """
    orders = [counts]
    for size in range(ORDER - 1, 0, -1):
        # How many different signs a shorter window follows: one row of the longer ones for each.
        kept = F.col("code").bitwiseAND((1 << (BITS * size)) - 1)
        shorter = orders[-1].groupBy("half", kept.alias("code")).agg(F.count("*").alias("n"))
        orders.append(stored(shorter, "window-counts"))
    below, grams, contexts = None, None, None
    for size, table in enumerate(reversed(orders), 1):
        rows = table.withColumns({"off": _off(table), "context": F.shiftright("code", BITS)})
        left = rows.groupBy("half", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("off_total"))
        rows = rows.join(left, ["half", "context"])
        share, rest = (F.col("n") - F.col("off")) / F.col("total"), F.col("off_total") / F.col("total")
        rows = rows.select("half", "code", "context", share.alias("share"), rest.alias("rest"))
        if below is None:
            rows = rows.withColumn("chance", F.col("share") + F.col("rest") / SIGNS)
        else:
            shorter = below.select("half", F.col("code").alias("end"), F.col("chance").alias("shorter"))
            end = F.col("code").bitwiseAND((1 << (BITS * (size - 1))) - 1)
            rows = rows.withColumn("end", end).join(shorter, ["half", "end"])
            rows = rows.withColumn("chance", F.col("share") + F.col("rest") * F.col("shorter"))
        below = stored(rows.select("half", "code", "context", "rest", "chance"), "window-chances")
        own = below.select("half", F.lit(size).alias("size"), "code", (-F.log2("chance")).cast("float").alias("bits"))
        lost = -F.log2(F.greatest("rest", F.lit(LEAST)))
        away = below.groupBy("half", F.lit(size).alias("size"), F.col("context").alias("code")).agg(F.first(lost).cast("float").alias("left"))
        grams = own if grams is None else grams.unionByName(own)
        contexts = away if contexts is None else contexts.unionByName(away)
    return stored(grams, "grams"), stored(contexts, "contexts")


@dataclass
class Shard:
    """A part of the model: by size of window the sorted codes, with the half above them, and bits."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    part: int
    parts: int

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last sign of windows, each under the model of its half; 0 for windows of other shards."""
        found = np.zeros(len(codes))
        places = np.arange(len(codes))
        if self.parts > 1:
            places = places[_part(codes >> BITS & (SIGNS**2 - 1), self.parts) == self.part]
        half = codes >> HALF << HALF
        for size in range(ORDER, 0, -1):
            window = codes[places] & ((1 << (BITS * size)) - 1) | half[places]
            known, bits = _at(self.grams[size - 1], window)
            found[places[known]] += bits[known]
            places, window = places[~known], window[~known]
            context = (window & ((1 << HALF) - 1)) >> BITS | half[places]
            known, left = _at(self.contexts[size - 1], context)
            found[places] += np.where(known, left, 0.0)
        found[places] += BITS
        return found


def _at(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, value) of codes in a sorted table."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(codes), bool), np.zeros(len(codes))
    place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return keys[place] == codes, values[place].astype(np.float64)


def _part(pair, parts: int):
    """The shard of two signs: arithmetic that columns and arrays share."""
    return (pair * 40503) % 65536 % parts


def shard(grams: DataFrame, contexts: DataFrame, part: int, parts: int, other: dict[int, int]) -> Shard:
    """One part of the model. ``other`` has, by half of a document, the half whose model scores it."""

    def tables(rows: DataFrame, value: str, pair: Column, longest: int) -> list:
        if parts > 1:
            # Shorter windows have no two signs before the last one: all shards have them.
            rows = rows.where((F.col("size") < longest) | (_part(pair, parts) == part))
        rows = rows.toArrow()
        half, size, code, values = (rows[name].to_numpy() for name in ("half", "size", "code", value))
        found = []
        for length in range(1, ORDER + 1):
            keys, worth = [], []
            for own, scored_by in other.items():
                here = (size == length) & (half == scored_by)
                keys.append(code[here] | own << HALF)
                worth.append(values[here])
            keys, worth = np.concatenate(keys), np.concatenate(worth)
            order = np.argsort(keys)
            found.append((keys[order], worth[order].astype(np.float32)))
        return found

    two = SIGNS**2 - 1
    before = F.shiftright("code", BITS).bitwiseAND(two)
    return Shard(
        tables(grams, "bits", before, 3), tables(contexts, "left", F.col("code").bitwiseAND(two), 3), part, parts
    )


MEASURES = ("total", "signs", "edge_total", "edge_signs")


def scored(docs: DataFrame, text: str, shards: list, names: list[str]) -> DataFrame:
    """``docs`` with four columns: bits and number of the signs of each text, and of those at edges of words.

    With several shards the rows are numbered and written, each shard makes a pass over the texts, and the bits are added up.
    """
    fields = [T.StructField(name, T.DoubleType() if at % 2 == 0 else T.LongType()) for at, name in enumerate(names)]
    (half,) = fresh(docs, "half")

    def passed(rows: DataFrame, part: Shard) -> DataFrame:
        # The texts go along once, as the column that they are.
        same = [name == text for name in rows.columns]
        body = same.index(True) if any(same) else [name.lower() for name in rows.columns].index(text.lower())
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                # Small batches go back, so that texts fill no memory on their way.
                for rows, texts, halves in _texts(batch, body):
                    codes, place, count = _windows(texts, halves)
                    bits, edge = table.bits(codes)[place], at_edge(codes)[place]
                    ends = np.cumsum(count)
                    sums = [np.concatenate([[0], np.cumsum(values)]) for values in (bits, bits * edge, edge)]
                    total, edges, number = (upto[ends] - upto[ends - count] for upto in sums)
                    out = batch.slice(rows.start, rows.stop - rows.start)
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns[:-1], pa.array(total), pa.array(count), pa.array(edges), pa.array(number.astype(np.int64))],
                        [*out.schema.names[:-1], *names],
                    )

        return map_rows(rows.withColumn(half, _half(quoted(text))), run, *fields)

    if len(shards) == 1:
        return passed(docs, shards[0]())
    (uid,) = fresh(docs, "uid")
    rows = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    sums = None
    for part in shards:
        one = stored(passed(rows.select(uid, quoted(text)), part()).drop(text), "shard-bits")
        sums = one if sums is None else sums.unionByName(one)
    # Every pass counts all signs; bits are those of its own windows.
    added = [F.sum(name) if at % 2 == 0 else F.first(name) for at, name in enumerate(names)]
    sums = sums.groupBy(uid).agg(*(value.alias(name) for value, name in zip(added, names)))
    return rows.join(sums, uid).drop(uid)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted): ids of all documents of quality 1. They are written, so Spark knows their size when it plans a join."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted")).distinct()
    return stored(good, "trusted")


def trusted_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, text) of the trusted documents, written. A bitmap of their ids, of fixed size, holds back nearly all other
    texts where they are read; the join, shuffled at every size, takes the rest out."""
    trusted = trusted_ids(labels)
    texts = docs.select(quoted(key).alias("trusted"), quoted(lang).alias("lang"), quoted(text).alias("text"))
    maybe = marked_keys(texts, stored(seen_sketch(trusted, "trusted"), "trusted-marks"), "trusted").where("marked")
    good = maybe.drop("marked").join(trusted.hint("merge"), "trusted", "left_semi").drop("trusted")
    return stored(good, "trusted-texts")


def fitted(good: DataFrame) -> list:
    """The shards of the model of trusted texts, each a function that fetches it."""
    grams, contexts = model(stored(window_counts(good, "text"), "window-counts"))
    rows = grams.groupBy("half").agg(F.count("*").alias("n")).collect()
    halves = {row.half for row in rows}
    # A half without texts has no model; its documents are scored by their own half's.
    other = {half: 1 - half if 1 - half in halves else half for half in (0, 1)}
    parts = max(1, math.ceil(sum(row.n for row in rows) / SHARD))
    return [lambda part=part: shard(grams, contexts, part, parts, other) for part in range(parts)]


@dataclass
class Limits:
    """The limits of one score: by language in a table, and those of all."""

    rows: DataFrame
    mean: float
    top: float


def _limits(known: DataFrame, total: str, number: str, prior: int, quantile: float) -> Limits:
    """From the scores of trusted texts."""
    spoken = known.where(F.col(number) > 0)
    means = spoken.where(F.col("lang").isNotNull()).groupBy("lang").agg(
        (F.sum(total) / F.sum(number)).alias("mean"), F.count("*").alias("texts")
    )
    pooled = spoken.agg(F.sum(total), F.sum(number)).first()
    mean = pooled[0] / pooled[1] if pooled[1] else 0.0

    def drawn(middle: Column) -> Column:
        return (F.col(total) + prior * middle) / (F.col(number) + prior)

    # Each language with a trusted text has a limit of its own, at every size of the input.
    means = stored(means, "language-means")
    own = spoken.join(means, "lang", "left")
    own = own.withColumn("drawn", drawn(F.coalesce("mean", F.lit(mean))))
    beyond = F.percentile_approx(F.col("drawn") - F.coalesce("mean", F.lit(mean)), quantile, 100_000)
    wider = WIDER * max(own.agg(beyond).first()[0] or 0.0, 0.0)
    own = own.where("mean IS NOT NULL").groupBy("lang").agg(
        F.first("mean").alias("mean"), F.first("texts").alias("texts"),
        F.percentile_approx("drawn", quantile, 100_000).alias("top"),
    )
    up = F.greatest(F.col("mean") + wider - F.col("top"), F.lit(0.0))
    own = own.withColumn("top", F.col("top") + up * ENOUGH / (F.col("texts") + ENOUGH))
    top = spoken.agg(F.percentile_approx(drawn(F.lit(mean)), quantile, 100_000)).first()[0]
    return Limits(stored(own.select("lang", "mean", "top"), "language-limits"), mean, math.inf if top is None else top)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    edge_margin: float = EDGE_MARGIN,
) -> DataFrame:
    """``docs`` with a struct ``quality`` of bits (the drawn-in bits per sign; perplexity is 2**bits),
    signs, limit, edge_bits, edge_limit and accepted."""
    good = trusted_texts(docs, labels, key, text, lang)
    shards = fitted(good)
    known = stored(scored(good, "text", shards, list(MEASURES)).drop("text"), "trusted-scores")

    mark, one, *names = fresh(docs, "quality", "_of", *(f"_{name}" for name in MEASURES))
    rows = scored(docs, text, shards, names)
    scores = []
    for total, number, prior, extra in ((0, 1, PRIOR, margin), (2, 3, EDGE_PRIOR, edge_margin)):
        limits = _limits(known, MEASURES[total], MEASURES[number], prior, quantile)
        mean, top = fresh(rows, "mean", "top")
        own = limits.rows.select(F.col("lang").alias(one), F.col("mean").alias(mean), F.col("top").alias(top))
        rows = rows.join(own, quoted(lang) == F.col(one), "left").drop(one)
        middle = F.coalesce(F.col(mean), F.lit(limits.mean))
        drawn = (F.col(names[total]) + prior * middle) / (F.col(names[number]) + prior)
        scores.append((drawn, F.coalesce(F.col(top), F.lit(limits.top)) + extra))
    (bits, limit), (edge_bits, edge_limit) = scores
    verdict = F.struct(
        bits.alias("bits"), F.col(names[1]).alias("signs"), limit.alias("limit"),
        edge_bits.alias("edge_bits"), edge_limit.alias("edge_limit"),
        ((bits <= limit) & (edge_bits <= edge_limit)).alias("accepted"),
    )
    return rows.withColumn(mark, verdict).select(*map(quoted, docs.columns), mark)


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, with all their columns."""
    (mark,) = fresh(docs, "quality")
    rows = judged(docs, labels, key, text, lang)
    return rows.where(F.col(mark)["accepted"]).drop(mark)
