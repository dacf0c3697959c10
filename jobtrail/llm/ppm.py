"""Language identification by prediction by partial matching (operator 9).

For each language a tree of byte contexts, up to three bytes long, counts which byte follows. A byte that
was seen behind the longest known context costs -log2(n / (N + d)) bits, with n its count there, N all
counts and d the number of different bytes; another one costs the escape, -log2(d / (N + d)), and is tried
behind the context without its first byte, down to 8 bits for any byte. Contexts that a language never met
cost nothing. A text's language is the one under which all its bytes cost least. The statistics don't change
while scoring, so the code lengths are sums of table entries: the trees of all languages are joined in one,
whose nodes hold a cost per language, and walking it is four table look-ups per byte.

Trees are learned from documents with a language whose crc32(id as text) mod 5 isn't 0. At most about
``PER_LANGUAGE`` documents of a language and ``SAMPLE`` in all are taken, by a hash of the id, whole
texts; this bounds the model, which is broadcast. Texts are lower-cased.

A null text and one without a letter is ``und`` with score 0. The score is the share of the best
language if languages weigh 2**-bits; of equal costs the language first by code point wins. Without
anything to learn from all is ``und``. A null id is held out. Extra columns aren't used; rows may repeat; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import quoted
from jobtrail.sources.shared import stored

#: Bytes of a window: a context of all but the last.
DEPTH = 4
FOLDS = 5
PER_LANGUAGE = 4_000
SAMPLE = 40_000
#: Bytes times languages that a task scores at a time.
CELLS = 1 << 22
UNKNOWN = "und"
UNIFORM = 8.0


@dataclass
class Trees:
    """The joined trees. Node k of depth d is a string of d bytes that some language has met."""

    languages: list[str]
    letter: np.ndarray  # the number of each byte; the last number is for bytes never met
    child: list[np.ndarray]  # of depth d: node of depth d-1 * letters + letter -> node of depth d or -1
    cost: list[np.ndarray]  # of depth d, by node and language: bits of its last byte behind the others
    escape: list[np.ndarray]  # of depth d, by node and language: bits to give it up as a context


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, count): lower-cased UTF-8, each text with DEPTH - 1 zero bytes before it."""
    pad = b"\0" * (DEPTH - 1)
    parts = [pad + (text or "").lower().encode("utf-8", "replace") for text in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    if len(sizes):
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(sizes)]])
        for start, stop in zip(cuts, cuts[1:]):
            yield slice(int(start), int(stop))


def window_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) of ``docs`` (lang, text): how often each window of DEPTH bytes occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.setdefault(lang, []).append(text)
            for lang, texts in rows.items():
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                for part in _parts(sizes, CELLS):
                    data, length = _windows(texts[part])
                    code = np.zeros(len(data), np.uint32)
                    for back in range(DEPTH):
                        code[back:] |= data[: len(data) - back].astype(np.uint32) << np.uint32(8 * back)
                    place = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
                    codes, n = np.unique(code[place >= DEPTH - 1], return_counts=True)
                    cuts = np.searchsorted(codes >> np.uint32(28), np.arange(17))
                    parts = [(s, slice(a, b)) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(parts), pa.string()),
                            pa.array([s for s, _ in parts], pa.int32()),
                            pa.array([codes[p].astype("<u4").tobytes() for _, p in parts], pa.binary()),
                            pa.array([n[p].astype("<i8").tobytes() for _, p in parts], pa.binary()),
                        ],
                        ["lang", "shard", "codes", "counts"],
                    )

    def add(rows: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), "<u4")
        found, place = np.unique(codes, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, np.frombuffer(b"".join(rows["counts"].to_pylist()), "<i8"))
        lang = pa.array([rows["lang"][0].as_py()] * len(found), pa.string())
        return pa.table({"lang": lang, "code": pa.array(found.astype(np.int64)), "n": total})

    packed = docs.select("lang", "text").mapInArrow(count, "lang string, shard int, codes binary, counts binary")
    return packed.groupBy("lang", "shard").applyInArrow(add, "lang string, code long, n long")


def grow(lang: list[str], code: np.ndarray, n: np.ndarray) -> Trees:
    """The joined trees from the counts of windows."""
    languages = sorted(set(lang))
    which = np.searchsorted(np.array(languages, object), np.array(lang, object)) if len(lang) else np.zeros(0, np.int64)
    bytes_ = np.stack([(code >> (8 * back)) & 255 for back in range(DEPTH)]) if len(code) else np.zeros((DEPTH, 0), np.int64)
    met = np.unique(np.append(bytes_, 0))
    letter = np.full(256, len(met), np.int64)
    letter[met] = np.arange(len(met))
    letters = len(met) + 1
    child, cost, escape, nodes = [], [], [], [np.zeros(1, np.int64)]
    for depth in range(1, DEPTH + 1):
        mask = (1 << (8 * depth)) - 1
        # All strings of this depth in the windows, since each is a context or the end of one.
        names = np.unique(np.concatenate([(code >> (8 * back)) & mask for back in range(DEPTH - depth + 1)]))
        table = np.zeros((len(names), len(languages)))
        np.add.at(table, (np.searchsorted(names, code & mask), which), n)
        above = np.searchsorted(nodes[-1], names >> 8)
        next_node = np.full(len(nodes[-1]) * letters, -1, np.int32)
        next_node[above * letters + letter[names & 255]] = np.arange(len(names))
        total, different = (np.zeros((len(nodes[-1]), len(languages))) for _ in range(2))
        np.add.at(total, above, table)
        np.add.at(different, above, (table > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            give_up = np.where(total > 0, -np.log2(different / (total + different)), 0.0)
            own = -np.log2(table / (total + different)[above])
        shorter = UNIFORM if depth == 1 else cost[-1][np.searchsorted(nodes[-1], names & (mask >> 8))]
        cost.append(np.where(table > 0, own, give_up[above] + shorter).astype(np.float32))
        escape.append(give_up.astype(np.float32))
        child.append(next_node)
        nodes.append(names)
    return Trees(languages, letter, child, cost, escape)


def code_lengths(t: Trees, texts: list[str | None]) -> np.ndarray:
    """Bits of each text under each language."""
    data, length = _windows(texts)
    letters = len(t.child[0])
    letter = t.letter[data]
    node = [np.zeros(len(data), np.int64)]
    for depth in range(DEPTH):
        before = np.concatenate([[-1], node[-1][:-1]]) if depth else node[0]
        here = t.child[depth][np.maximum(before, 0) * letters + letter]
        node.append(np.where(before >= 0, here, -1).astype(np.int64))
    bits = np.zeros((len(data), len(t.languages)), np.float32)
    todo = np.arange(len(data))
    for depth in range(DEPTH, 0, -1):
        at = node[depth][todo]
        found = at >= 0
        bits[todo[found]] += t.cost[depth - 1][at[found]]
        todo = todo[~found]
        context = node[depth - 1][todo - 1] if depth > 1 else np.zeros(len(todo), np.int64)
        inside = (context >= 0) & (todo > 0)
        bits[todo[inside]] += t.escape[depth - 1][context[inside]]
    bits[todo] += UNIFORM
    start = np.cumsum(length) - length
    bits[(start[:, None] + np.arange(DEPTH - 1)).ravel()] = 0
    return np.add.reduceat(bits.astype(np.float64), start, axis=0) if len(length) else np.zeros((0, len(t.languages)))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Trees:
    """Trees from the documents that aren't held out."""
    rows = docs.select(quoted(key).alias("id"), quoted(lang).alias("lang"), quoted(text).alias("text"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    kinds = max(1, sizes.count())
    share = F.lit(min(PER_LANGUAGE, max(1, SAMPLE // kinds))) / F.col("n")
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(sizes.withColumn("share", share).select("lang", "share"), "lang").where(chance < F.col("share"))
    counts = window_counts(rows).toArrow()
    return grow(counts["lang"].to_pylist(), counts["code"].to_numpy(), counts["n"].to_numpy())


def identify(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trees(**shared.value)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            for rows in _parts(sizes, CELLS // max(4, len(t.languages))):
                part = batch.slice(rows.start, rows.stop - rows.start)
                texts = part.column(1).to_pylist()
                named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if t.languages:
                    bits = code_lengths(t, texts)
                    best = bits.argmin(axis=1)
                    above = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
                    share = 1 / np.exp2(-above).sum(axis=1)
                    for at, one in enumerate(texts):
                        if one and any(map(str.isalpha, one)):
                            named[at], score[at] = t.languages[best[at]], share[at]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(named, pa.string()), pa.array(score)], ["id", "lang_pred", "score"]
                )

    rows = docs.select(quoted(key).alias("id"), quoted(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double")
    return found.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
