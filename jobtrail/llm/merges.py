"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 4).

A task looks up each word of its texts in a table of words it has met (cleared when it is full), and
encodes the new ones together. All their characters lie in one flat array of symbols. Two
neighbouring characters that stand next to each other in no piece can never end up in one
symbol, so the array is cut between them; the segments are independent. In a round every
segment finds the smallest rank among its pairs, merges its leftmost pairs of that rank, all segments at once,
and the array is compacted; segments without a mergeable pair are done. Several pairs of
a segment are merged in the same round only if none of the pairs that they make ranks as high as they do,
so the result is that of merging one at a time.

The model file is read by the sentencepiece library on the driver; the tables made from it, a few MB that
depend on the vocabulary only, are broadcast. A model must be BPE without text normalising, with a dummy
prefix and byte fallback; others are refused.

A null text counts as empty and has no ids. Texts of any length are encoded whole. Extra columns stay as
they are; the new column gets underscores if its name is taken. Rows may repeat. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobtrail.llm.common import fresh, map_rows, quoted

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Words a task remembers, and characters it encodes or decodes at a time.
WORDS = 400_000
CHARS = 1 << 21


@dataclass
class Tables:
    """What encoding and decoding need of a model."""

    symbol_of: np.ndarray  # of each code point; -1: in no piece
    near: np.ndarray  # sorted pairs of code points that stand together in some piece
    near_rank: np.ndarray  # of each of these pairs as two symbols; NONE: it doesn't merge
    near_merged: np.ndarray
    pair: np.ndarray  # sorted left * symbols + right
    rank: np.ndarray  # of each pair, smaller is merged first; equal scores have equal ranks
    merged: np.ndarray  # the symbol that each pair makes
    symbols: int
    pieces: int  # symbols below are ids, those above are characters without a piece
    byte_id: np.ndarray
    by_word: bool  # no piece goes on behind a space
    surface: np.ndarray  # UTF-8 bytes of all ids
    start: np.ndarray  # where each id's bytes start; one more at the end
    opens: np.ndarray  # ids whose surface starts with a space


def load(path: str) -> Tables:
    """The tables of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
    pieces = {model.id_to_piece(i): i for i in range(size) if not special[i]}
    byte_id = np.array([model.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)], np.int32)
    sample = "  Aé ﬁ\t\n ͸x "
    if not all(model.is_byte(int(i)) for i in byte_id) or model.decode(model.encode(sample)) != sample:
        raise ValueError("the model must have byte fallback and must not change texts")
    if model.encode("a", out_type=str)[0][0] != SPACE:
        raise ValueError("the model must put a space before texts")

    symbols = dict(pieces)
    near, pairs = set(), {}
    for piece in pieces:
        for char in piece:
            symbols.setdefault(char, size + len(symbols) - len(pieces))
    for piece in pieces:
        near.update(zip(piece, piece[1:]))
        for cut in range(1, len(piece)):
            left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left, right] = symbols[piece]
    count = size + len(symbols) - len(pieces)
    symbol_of = np.full(0x110000, -1, np.int32)
    for symbol, number in symbols.items():
        if len(symbol) == 1:
            symbol_of[ord(symbol)] = number
    scores = np.array([model.get_score(i) for i in range(size)])
    ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    key = np.array([left * count + right for left, right in pairs], np.int64)
    order = np.argsort(key)
    merged = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    near = sorted(near, key=lambda ab: (ord(ab[0]), ord(ab[1])))
    together = [pairs.get((symbols[a], symbols[b])) for a, b in near]

    surfaces = []
    for i in range(size):
        if model.is_byte(i):
            surfaces.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        elif model.is_control(i):
            surfaces.append(b"")
        elif model.is_unknown(i):
            surfaces.append(model.decode([i]).encode())
        else:
            surfaces.append(model.id_to_piece(i).replace(SPACE, " ").encode())
    return Tables(
        symbol_of=symbol_of,
        near=np.array([ord(a) * 0x110000 + ord(b) for a, b in near], np.int64),
        near_rank=np.array([NONE if new is None else ranks[new] for new in together], np.int32),
        near_merged=np.array([new or 0 for new in together], np.int32),
        pair=key[order],
        rank=ranks[merged],
        merged=merged,
        symbols=count,
        pieces=size,
        byte_id=byte_id,
        by_word=all(b != SPACE or a == SPACE for a, b in near),
        surface=np.frombuffer(b"".join(surfaces), np.uint8),
        start=np.concatenate([[0], np.cumsum([len(s) for s in surfaces])]).astype(np.int64),
        opens=np.array([s[:1] == b" " for s in surfaces]),
    )


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    np.minimum(at, len(keys) - 1, out=at)
    return at, keys[at] == wanted


def _look_up(t: Tables, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, merged) of pairs; the rank is NONE if they don't merge."""
    at, found = _find(t.pair, left.astype(np.int64) * t.symbols + right)
    found &= (left >= 0) & (right >= 0)
    return np.where(found, t.rank[at], NONE), t.merged[at]


def merge_rounds(
    t: Tables, symbol: np.ndarray, segment: np.ndarray, rank: np.ndarray, merged: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, place) in order: what the symbols of each segment merge to, and the place of
    each one's first symbol. ``segment`` numbers rise; ``rank`` and ``merged`` are those of each
    symbol with the next."""
    place = np.arange(len(symbol), dtype=np.int32)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        first = np.concatenate([[True], segment[1:] != segment[:-1]])
        starts = np.nonzero(first)[0]
        least = np.minimum.reduceat(rank, starts)
        length = np.diff(np.append(starts, len(symbol)))
        ended = least == NONE
        if ended.any():
            out = np.repeat(ended, length)
            done.append((symbol[out], place[out]))
            stay = ~out
            symbol, place, segment, rank, merged = (x[stay] for x in (symbol, place, segment, rank, merged))
            if not len(symbol):
                break
            least, length = least[~ended], length[~ended]
        number = np.repeat(np.arange(len(least)), length)
        hit = rank == least[number]
        # Of overlapping pairs the first, third, ... are merged, counted from the left.
        spots = np.nonzero(hit)[0]
        opens = np.concatenate([[True], np.diff(spots) > 1])
        head = spots[np.maximum.accumulate(np.where(opens, np.arange(len(spots)), 0))]
        spots = spots[(spots - head) % 2 == 0]
        new = merged[spots]
        inside = number[spots]
        last = len(symbol) - 1
        # The pairs each merge makes if those to its left are merged and those to its right are not.
        before = np.maximum(spots - 1, 0)
        joined = np.concatenate([[False], (np.diff(spots) == 2) & (inside[1:] == inside[:-1])])
        left = np.where(joined, np.concatenate([[0], new[:-1]]), symbol[before])
        has_left = (spots > 0) & (number[before] == inside)
        after = np.minimum(spots + 2, last)
        has_right = (spots + 2 <= last) & (number[after] == inside)
        made = np.minimum(
            np.where(has_left, _look_up(t, left, new)[0], NONE),
            np.where(has_right, _look_up(t, new, symbol[after])[0], NONE),
        )
        alone = np.zeros(len(least), bool)
        alone[inside[made <= least[inside]]] = True
        leftmost = np.concatenate([[True], inside[1:] != inside[:-1]])
        chosen = leftmost | ~alone[inside]
        spots, new = spots[chosen], new[chosen]

        symbol[spots] = new
        stay = np.ones(len(symbol), bool)
        stay[spots + 1] = False
        moved = np.cumsum(stay) - 1
        symbol, place, segment, rank, merged = (x[stay] for x in (symbol, place, segment, rank, merged))
        spots = moved[spots]
        touched = np.zeros(len(symbol), bool)
        touched[spots] = True
        touched[np.maximum(spots - 1, 0)] = True
        changed = np.nonzero(touched)[0]
        follows = np.minimum(changed + 1, len(symbol) - 1)
        paired = (changed + 1 < len(symbol)) & (segment[follows] == segment[changed])
        found, makes = _look_up(t, symbol[changed], symbol[follows])
        rank[changed] = np.where(paired, found, NONE)
        merged[changed] = makes
    symbol = np.concatenate([s for s, _ in done]) if done else symbol
    place = np.concatenate([p for _, p in done]) if done else place
    order = np.argsort(place)
    return symbol[order], place[order]


def encode_words(t: Tables, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count): the ids of all words one after the other, and how many each has."""
    text = "".join(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    number = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    at, near = _find(t.near, points[:-1] * 0x110000 + points[1:])
    near &= number[1:] == number[:-1]
    segment = np.concatenate([[0], np.cumsum(~near, dtype=np.int32)]).astype(np.int32)
    rank = np.append(np.where(near, t.near_rank[at], NONE), NONE).astype(np.int32)
    merged = np.append(t.near_merged[at], 0).astype(np.int32)
    symbol, place = merge_rounds(t, t.symbol_of[points], segment, rank, merged)
    number = number[place]

    # Characters without a piece become their UTF-8 bytes.
    strange = (symbol < 0) | (symbol >= t.pieces)
    point = points[place]
    width = 1 + (strange & (point > 0x7F)) + (strange & (point > 0x7FF)) + (strange & (point > 0xFFFF))
    ids = np.repeat(symbol, width)
    starts = np.cumsum(width) - width
    if strange.any():
        odd = np.nonzero(strange)[0]
        data = np.frombuffer("".join(map(chr, point[odd])).encode(), np.uint8)
        to = np.repeat(starts[odd] - (np.cumsum(width[odd]) - width[odd]), width[odd]) + np.arange(len(data))
        ids[to] = t.byte_id[data]
    return ids.astype(np.int32), np.bincount(number, weights=width, minlength=len(words)).astype(np.int64)


class Words(dict):
    """Numbers of the words met; new ones wait to be encoded."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.waiting: list[str] = []
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.waiting.append(SPACE + word)
        return number

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of the words with these numbers."""
        if self.waiting:
            ids, count = encode_words(self.tables, self.waiting)
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(count)])
            self.waiting = []
        begin = self.start[numbers]
        count = self.start[numbers + 1] - begin
        return take(self.ids, begin, count), count


def take(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices of ``values`` one after the other."""
    ends = np.cumsum(count)
    shift = np.repeat(begin - (ends - count), count)
    return values[shift + np.arange(ends[-1] if len(ends) else 0)]


def split_words(t: Tables, text: str) -> list[str]:
    """The parts that are encoded alone, each without the space before it."""
    if not text:
        return []
    if not t.by_word:
        return [text.replace(" ", SPACE)]
    if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
        whole = SPACE + text.replace(" ", SPACE)
        return [unit[1:] for unit in re.findall(f"{SPACE}+[^{SPACE}]*", whole)]
    return text.split(" ")


def encode_texts(known: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count) of texts."""
    if len(known) > WORDS:
        known.clear()
    numbers: list[int] = []
    units = np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        words = split_words(known.tables, text or "")
        units[at] = len(words)
        numbers.extend(map(known.__getitem__, words))
    ids, count = known.gather(np.array(numbers, np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])
    upto = np.cumsum(units)
    return ids, ends[upto] - ends[upto - units]


def decode_ids(t: Tables, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length): the UTF-8 of all texts one after the other, and the bytes of each."""
    begin = t.start[ids]
    width = t.start[ids + 1] - begin
    first = (np.cumsum(count) - count)[count > 0]
    # The space that encoding puts before a text goes.
    opens = t.opens[ids[first]]
    begin[first] += opens
    width[first] -= opens
    upto = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(count)
    return take(t.surface, begin, width), upto[ends] - upto[ends - count]


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows with about ``most`` in all, and one row at least."""
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // most
    cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(sizes)]])
    for start, stop in zip(cuts, cuts[1:]):
        yield slice(int(start), int(stop))


def _with(batch: pa.RecordBatch, rows: slice, column: pa.Array, name: str) -> pa.RecordBatch:
    part = batch.slice(rows.start, rows.stop - rows.start)
    return pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])


def encode(docs: DataFrame, model: Tables, text: str = "text", ids: str = "ids", drop: tuple = ()) -> DataFrame:
    """``docs`` with an array of ids of ``text``, without the columns in ``drop``."""
    (name,) = fresh(docs, ids)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(model))
    (body,) = fresh(docs, "body")
    rows = docs.select(*(quoted(column) for column in docs.columns if column not in drop), quoted(text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(Tables(**shared.value))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], np.int64)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            for rows in _parts(sizes, CHARS):
                found, count = encode_texts(known, texts.slice(rows.start, rows.stop - rows.start).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield _with(rest, rows, pa.ListArray.from_arrays(offsets, pa.array(found)), name)

    return map_rows(rows, run, T.StructField(name, T.ArrayType(T.IntegerType())))


def encode_checked(docs: DataFrame, model: Tables, text: str, ids: str, whole: str) -> DataFrame:
    """``docs`` with ids in place of ``text``, and whether decoding them gives it again.

    Both happen in one Python worker per task, and the text doesn't come back from it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    (body,) = fresh(docs, "body")
    rows = docs.select(*(quoted(column) for column in docs.columns if column != text), quoted(text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(**shared.value)
        known = Words(tables)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy().astype(np.int64)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            for rows in _parts(sizes, CHARS // 2):
                given = texts.slice(rows.start, rows.stop - rows.start).to_pylist()
                found, count = encode_texts(known, given)
                data, length = decode_ids(tables, found, count)
                stops = np.cumsum(length)
                # The model's sign for a space is read back as a space.
                same = [
                    data[start:stop].tobytes() == (one or "").replace(SPACE, " ").encode()
                    for one, start, stop in zip(given, stops - length, stops)
                ]
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                part = _with(rest, rows, pa.ListArray.from_arrays(offsets, pa.array(found)), ids)
                yield _with(part, slice(0, len(same)), pa.array(same, pa.bool_()), whole)

    return map_rows(rows, run, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(whole, T.BooleanType()))


def decode(encoded: DataFrame, model: Tables, ids: str = "ids", text: str = "decoded", drop: tuple = ()) -> DataFrame:
    """``encoded`` with the text that ``ids`` (as ``encode`` makes them; null: none) stand for."""
    (name,) = fresh(encoded, text)
    shared = encoded.sparkSession.sparkContext.broadcast(vars(model))
    (given,) = fresh(encoded, "given")
    rows = encoded.select(*(quoted(column) for column in encoded.columns if column not in drop), quoted(ids).alias(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(**shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            for rows in _parts(sizes, CHARS // 4):
                flat = lists.slice(rows.start, rows.stop - rows.start).flatten().to_numpy()
                data, length = decode_ids(tables, flat, sizes[rows])
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                texts = pa.StringArray.from_buffers(
                    len(length), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())
                )
                yield _with(rest, rows, texts, name)

    return map_rows(rows, run, T.StructField(name, T.StringType()))
