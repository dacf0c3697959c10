"""Token ids in a compact file format: canonical length-limited Huffman codes (operator 10).

1. Tasks tokenise the texts and write the ids.
2. The counts of all ids are added up, by shares of the vocabulary; code lengths come from package-merge with a
   limit, and lengths alone fix the canonical codes.
3. Every document's ids are coded, each document from a whole byte on.
4. Documents are range-partitioned and sorted by id, and put together to blocks of about a million
   ids, which are independent of each other: a block names its documents, their numbers of ids, the
   coded bytes, and the bit offset of every 256th id.
5. Reading decodes a block by table: each step looks up the next bits of all offsets at once.

A set of files is a folder with two Parquet tables, ``codes`` (id, length) and ``blocks``, written and read by Spark;
the rows of ``blocks`` are in ascending order of documents, file after file.

A null text counts as empty. Each document ends with the end id, so it has one id at least. Rows repeated with
their id are documents of their own, in the order of their coded bytes; null ids come first. Extra columns are not
written. An empty table gives files without blocks. Texts of any length are coded whole; a
document is never parted, so a block is as large as its largest document at least.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import forget, quoted, release
from jobtrail.sources.shared import new_folder

#: The longest code, in bits, for vocabularies of up to 65,536 ids.
LIMIT = 16
#: Ids between two checkpoints, and in a block.
STEP = 256
BLOCK = 1 << 20
#: Chunks and words that a worker remembers the ids of, and characters it tokenises at a time.
CHUNKS = 1_500_000
CHARS = 1 << 21
#: Parts of the vocabulary whose counts are added up by different tasks.
SHARES = 16


# --- tokens ---

#: Chunks of printable ASCII and Latin-1 letters, which the normaliser only lower-cases.
PLAIN = re.compile(r"[\x21-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
#: The definition's pattern for words, for lower-cased chunks of that kind.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words(dict):
    """Ids of the words met, by the tokenizer's model alone, packed as 16-bit numbers."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = tokenizer.model
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {code: spelled.pre_tokenize_str(chr(code))[0][0] for code in range(0xC0, 0x100)}

    def __missing__(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.translate(self.letters)
        self[word] = ids = array("H", [token.id for token in self.model.tokenize(spelled)]).tobytes()
        return ids


class Chunks(dict):
    """Packed ids of the chunks met; a worker keeps them between its tasks."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        given = json.loads(definition)
        kinds = [part["type"] for part in (given["normalizer"] or {}).get("normalizers", ())]
        steps = (given["pre_tokenizer"] or {}).get("pretokenizers", ())
        # Where the definition splits and spells words in the known way, whole chunks need not go through it.
        self.direct = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [step["type"] for step in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": PATTERN}
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and (steps[1]["add_prefix_space"], steps[1]["use_regex"]) == (False, False)
        )
        self.words = Words(self.tokenizer)

    def plain(self, chunk: str) -> bool:
        return PLAIN.fullmatch(chunk) is not None and not any(s in chunk for s in self.special)

    def __missing__(self, chunk: str) -> bytes:
        if self.direct and chunk.isascii() and chunk.isalpha():
            ids = self.words[chunk.lower()]
        elif self.direct and self.plain(chunk):
            ids = b"".join(map(self.words.__getitem__, WORD.findall(chunk.lower())))
        else:
            ids = array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids


def _known(definition: str) -> Chunks:
    """The worker's table. Functions travel to workers by value, so it hangs on a module of its own."""
    kept = sys.modules.setdefault("_known_chunks", types.ModuleType("_known_chunks"))
    key = zlib.crc32(definition.encode())
    if getattr(kept, "key", None) != key:
        kept.key, kept.chunks = key, Chunks(definition)
    return kept.chunks


def tokenise(known: Chunks, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count) of texts, each with the end id.

    The tokenizer drops white space and joins nothing across it, so chunks between blanks are tokenised alone.
    """
    for table in (known, known.words):
        if len(table) > CHUNKS:
            table.clear()
    last, get = array("H", [end]).tobytes(), known.__getitem__
    found = []
    for text in texts:
        chunks = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found.append(b"".join(map(get, chunks)) + last)
    return np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, len(found)) // 2


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    if len(sizes):
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(sizes)]])
        for start, stop in zip(cuts, cuts[1:]):
            yield slice(int(start), int(stop))


def _slices(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of these sizes, one after the other in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )


def _flat(values: pa.Array) -> np.ndarray:
    """The bytes of binary values, one after the other."""
    values = pa.concat_arrays([values])
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(values) else np.zeros(0, np.uint8)


def token_ids(docs: DataFrame, definition: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, ids): each document's ids as little-endian 16-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy().astype(np.int64)
            for rows in _parts(sizes, CHARS):
                part = batch.slice(rows.start, rows.stop - rows.start)
                ids, n = tokenise(known, part.column(1).to_pylist(), end)
                arrays = [part.column(0), pa.array(n, pa.int64()), _slices(ids.astype("<u2"), 2 * n)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "ids"])

    rows = docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, ids binary")


# --- codes ---


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The lengths of an optimal prefix code of at most ``limit`` bits; 0 for ids without a count."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    packages, is_leaf = np.zeros(0), []
    for _ in range(limit):
        row = np.concatenate([leaves, packages])
        order = np.argsort(row, kind="stable")
        is_leaf.append(order < len(leaves))
        row = row[order]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for leaf in reversed(is_leaf):
        own = int(leaf[:taken].sum())
        depth[:own] += 1
        taken = 2 * (taken - own)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.nonzero(lengths)[0]
    used = used[np.argsort(lengths[used], kind="stable")]
    code, last = 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        same = used[lengths[used] == size]
        code <<= size - last
        codes[same] = code + np.arange(len(same))
        code, last = code + len(same), size
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every value of the next ``limit`` bits."""
    codes = canonical_codes(lengths).astype(np.int64)
    ids, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    used = np.nonzero(lengths)[0]
    span = 1 << (limit - lengths[used].astype(np.int64))
    at = np.repeat(codes[used] * span - (np.cumsum(span) - span), span) + np.arange(span.sum())
    ids[at], sizes[at] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, sizes


def encode(ids: np.ndarray, n: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """(bytes, size, marks): documents coded one after the other, each from a whole byte on, the bytes
    of each, and the bit, from its own start, at which each document's 1st, 257th, ... id starts."""
    width = lengths[ids].astype(np.int64)
    first = np.cumsum(n) - n
    before = np.cumsum(width) - width
    bits = np.add.reduceat(width, first) if len(n) else np.zeros(0, np.int64)
    size = (bits + 7) // 8
    inside = before - np.repeat(before[first], n)
    at = inside + np.repeat((np.cumsum(size) - size) * 8, n)
    place = np.arange(len(ids)) - np.repeat(first, n)
    value = codes[ids].astype(np.int64) << (24 - width - (at & 7))
    byte, total = at >> 3, int(size.sum())
    data = np.zeros(total + 3)
    for step in range(3):
        data += np.bincount(byte + step, (value >> (16 - 8 * step)) & 255, total + 3)
    return data[:total].astype(np.uint8), size, inside[place % STEP == 0].astype("<u4")


def decode(data: np.ndarray, marks: np.ndarray, counts: np.ndarray, table: tuple, limit: int = LIMIT) -> np.ndarray:
    """The ids behind each mark (a bit offset), ``counts`` of them, one run after the other."""
    symbol, size = table
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    # Longest runs first, so those still going on are always the first ones.
    order = np.argsort(-counts, kind="stable")
    at, left = marks[order].astype(np.int64), counts[order]
    target = (np.cumsum(counts) - counts)[order]
    ids = np.zeros(counts.sum(), np.uint32)
    going = np.searchsorted(-left, -np.arange(counts.max(initial=0)), "left")
    for step, k in enumerate(going.tolist()):
        now = at[:k]
        bits = (window[now >> 3] >> (32 - limit - (now & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        ids[target[:k] + step] = symbol[bits]
        at[:k] += size[bits]
    return ids


# --- files ---


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs. As many numbers as the vocabulary has come to the driver."""
    width = -(-vocabulary // SHARES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width * SHARES, np.int64)
        for batch in batches:
            found += np.bincount(_flat(batch.column(0)).view("<u2"), minlength=len(found))
        parts = [found[share * width : (share + 1) * width].tobytes() for share in range(SHARES)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SHARES), pa.int32()), pa.array(parts, pa.binary())], ["share", "counts"]
        )

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(part, np.int64) for part in rows["counts"].to_pylist())
        return pa.table({"share": rows["share"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "share int, counts binary"
    shares = tokens.select("ids").mapInArrow(count, schema).groupBy("share").applyInArrow(add, schema)
    counts = np.zeros(width * SHARES, np.int64)
    for row in shares.collect():
        counts[row.share * width : (row.share + 1) * width] = np.frombuffer(row.counts, np.int64)
    return counts[:vocabulary]


def _write(df: DataFrame, folder: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _coded(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            for rows in _parts(n, CHARS // 8):
                part = batch.slice(rows.start, rows.stop - rows.start)
                count = n[rows]
                data, size, marks = encode(_flat(part.column(2)).view("<u2"), count, codes, lengths)
                marked = _slices(marks, 4 * (-(-count // STEP)))
                arrays = [part.column(0), part.column(1), _slices(data, size), marked]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "data", "marks"])

    return tokens.mapInArrow(run, "id long, n long, data binary, marks binary")


def _blocks(coded: DataFrame) -> DataFrame:
    """Sorted coded documents put together to blocks, numbered inside their partition."""

    def block(number: int, before: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        n, size = rows.column(1).to_numpy(), pa.compute.binary_length(rows.column(2)).to_numpy().astype(np.int64)
        marks = _flat(rows.column(3)).view("<u4") + np.repeat((np.cumsum(size) - size) * 8, -(-n // STEP))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([before], pa.int64()),
                pa.array([int(n.sum())], pa.int64()),
                pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([n], pa.list_(pa.int64())),
                pa.array([_flat(rows.column(2)).tobytes()], pa.binary()),
                pa.array([np.diff(marks, prepend=0).astype("<u4").tobytes()], pa.binary()),
            ],
            ["number", "before", "total", "ids", "n", "data", "marks"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = before = 0
        for batch in batches:
            for rows in _parts(batch.column(1).to_numpy(), BLOCK):
                part = batch.slice(rows.start, rows.stop - rows.start)
                made = block(number, before, part)
                yield made
                number, before = number + 1, before + made.column(2)[0].as_py()

    schema = "number long, before long, total long, ids array<long>, n array<long>, data binary, marks binary"
    return coded.mapInArrow(run, schema)


def write_ids(docs: DataFrame, folder: str, definition: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, ``end`` behind each, to ``folder``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_str(definition).get_vocab_size(), end + 1)
    if size > 1 << 16:
        raise ValueError("ids must fit in 16 bits")
    first, second = new_folder(spark, "ids"), new_folder(spark, "coded")
    tokens = _write(token_ids(docs, definition, end, key, text), first)
    lengths = code_lengths(id_counts(tokens, size))
    used = [(int(i), int(lengths[i])) for i in np.nonzero(lengths)[0]]
    _write(spark.createDataFrame(used, "id int, length int").coalesce(1), f"{folder}/codes")
    coded = _write(_coded(tokens, lengths), second)
    forget(spark, first)
    order = [F.col("id").asc_nulls_first(), F.col("n"), F.xxhash64("data"), F.col("data")]
    ranged = coded.repartitionByRange(order[0]).sortWithinPartitions(*order)
    _write(_blocks(ranged).withColumn("part", F.spark_partition_id()), f"{folder}/blocks")
    release(spark)
    forget(spark, second)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n, ids): documents in any order, ``start`` ids before each, ``ids`` as little-endian 32-bit numbers."""
    codes = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max([row.id for row in codes], default=0) + 1, np.uint8)
    for row in codes:
        lengths[row.id] = row.length
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("total").alias("ahead"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per file: the number of partitions that wrote bounds it.
    sizes = F.broadcast(sizes.select("part", F.coalesce(F.sum("ahead").over(earlier), F.lit(0)).alias("ahead")))
    rows = blocks.join(sizes, "part").select((F.col("ahead") + F.col("before")).alias("start"), "ids", "n", "data", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for at in range(len(batch)):
                start, ids, n = batch.column(0)[at].as_py(), batch.column(1)[at].values, batch.column(2)[at].values
                n = n.to_numpy()
                data = np.frombuffer(batch.column(3)[at].as_buffer(), np.uint8)
                marks = np.cumsum(np.frombuffer(batch.column(4)[at].as_buffer(), "<u4").astype(np.int64))
                runs = -(-n // STEP)
                counts = np.full(len(marks), STEP, np.int64)
                counts[np.cumsum(runs) - 1] = n - STEP * (runs - 1)
                found = decode(data, marks, counts, table)
                arrays = [ids, pa.array(start + np.cumsum(n) - n), pa.array(n), _slices(found.astype("<u4"), 4 * n)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "n", "ids"])

    return rows.mapInArrow(run, "id long, start long, n long, ids binary")
