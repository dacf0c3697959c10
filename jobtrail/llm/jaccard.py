"""N-gram Jaccard join with adaptive multi-match prefixes (operator 1).

Documents are sets of distinct word shingles; two link when their sets' Jaccard similarity
reaches the threshold. All tokens (shingles) are ordered by how many documents hold them, rarest first,
then by hash. If two sets of sizes m and n must share at least a tokens, then for every
l the first m-a+l of one and n-a+l of the other share at least l. Each document chooses its own l:
it lengthens its prefix as long as the postings it adds cost less than the candidates it
saves, and a pair is verified if it shares at least the smaller l of the two.

1. Texts are cut into blocks of some MB. A task hashes their shingles, sorts them and sends each bucket
   of the hash range packed rows per block: 7 bytes per token. A token that CROWD or more documents of the block hold
   goes once with their number; who they are stays with the block's own row, which goes by a hash of the block.
2. A bucket counts the documents of each of its tokens. Tokens that only one document holds can link
   nothing; the others go back to their block with their count. So a token sends a bucket fewer than CROWD entries
   a block, were it in every document, and the number of buckets grows with the bytes of all texts.
3. A block knows for each document how many tokens are its own alone. If they fill the shortest
   prefix, no other document can reach the threshold, and the document is done. The rest, few, keep the
   tokens that others have too: all that a pair can share, so enough to verify it exactly.
4. Documents with equal sets are one. Prefix tokens are posted; a posting list pairs only documents whose
   sizes and places in the order allow the threshold.
5. A list with many near copies must not give all its pairs. First each list pairs its members with two
   of them, the one whose tokens are held most often and one that a hash chooses. What these pairs link is merged to components. Then only members outside the
   list's largest component are paired, with members of other components; of those, all pairs.

Sets are compared by 64-bit hashes of their shingles, cut to the bits of bucket and token (at least
45). Nothing is sampled or capped; hot tokens and groups only change the order of the work.

A document with fewer words than a shingle has its whole sequence as one; without words or text its
set is empty and links with nothing. Documents with the same set link. Rows repeated with their id, and null ids, are
documents of their own. An empty table gives an empty table. If a task is repeated it must
meet its documents in the same order, as when reading a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import partitions, quoted, release
from jobtrail.llm.components import components
from jobtrail.sources.shared import stored

WORDS = 5
PERCENT = 75
#: Bytes of text in a block, and documents, whose numbers take two bytes.
BLOCK = 6 << 20
MOST_DOCS = 60_000
#: Bytes of text whose words and shingles are worked out at a time: these take some thirty times as much memory.
SLICE = 1 << 19
#: Bytes of a token besides its bucket.
TOKEN = 5
#: From so many documents of a block on, a token is counted there: what it then takes is less than it saves.
CROWD = 4
#: Bytes of tokens that a bucket holds in the mean, for words of three letters and more, and the most bits of its number.
BUCKET = 64 << 20
MOST_BITS = 24
#: The longest a prefix grows, and the cost of verifying one candidate in postings per token it has.
LONGEST = 16
VERIFY = 0.002

U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_PACKED = "bucket int, block long, a binary, b binary, c binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * B
    x = (x ^ (x >> U(27))) * C
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, count): 64-bit hashes of the lower-cased words of all texts, and how many each has.

    Text i is the bytes from offsets[i] to offsets[i + 1].
    """
    size = len(data)
    padded = np.zeros(size + 8, np.uint8)
    padded[:size] = _LOWER[data]
    black = np.zeros(size + 2, bool)
    black[1:-1] = ~_WHITE[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    starts = np.nonzero(black[1:-1] & (~black[:-2] | edge[:-1]))[0]
    ends = np.nonzero(black[1:-1] & (~black[2:] | edge[1:]))[0] + 1
    eight = np.ndarray((size + 1,), "<u8", padded.data, 0, (1,))
    left = ends - starts
    hashes = _mix(left.astype(U) * A)
    at, rows = starts.copy(), np.arange(len(starts))
    while len(rows):
        chunk = eight[at]
        short = left < 8
        keep = (U(1) << (U(8) * np.where(short, left, 0).astype(U))) - U(1)
        chunk = np.where(short, chunk & keep, chunk)
        hashes[rows] = _mix((hashes[rows] ^ chunk) * A + C)
        more = left > 8
        at, left, rows = at[more] + 8, left[more] - 8, rows[more]
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, count: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, document): hashes of all shingles, documents in order; not yet distinct."""
    document = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    found, owner = [], []
    if len(hashes) >= words:
        token = hashes[: len(hashes) - words + 1].copy()
        for step in range(1, words):
            token = token * A + hashes[step : len(hashes) - words + 1 + step]
        whole = document[: len(token)] == document[words - 1 :]
        found.append(_mix(token[whole]))
        owner.append(document[: len(token)][whole])
    for size in range(1, words):
        docs = np.nonzero(count == size)[0]
        token = np.zeros(len(docs), U)
        for step in range(size):
            token = token * A + hashes[first[docs] + step]
        found.append(_mix(token + U(size * int(B) % 2**64)))
        owner.append(docs)
    tokens, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return tokens[order], owner[order]


def distinct(tokens: np.ndarray, owner: np.ndarray, docs: int):
    """(tokens, owner, n, sums): sorted by token without repeats, and of each document the number
    of tokens and two sums over them that tell sets apart."""
    order = np.argsort(tokens, kind="stable")
    tokens, place = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (place[1:] != place[:-1])
    tokens, place, order = tokens[new], place[new], order[new]
    n = np.bincount(place, minlength=docs)
    sums = np.zeros((2, docs), U)
    if len(owner):
        first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
        for row, factor in enumerate((B, C)):
            values = np.zeros(len(owner), U)
            values[order] = _mix(tokens * factor + A)
            sums[row, owner[first]] = np.add.reduceat(values, first)
    return tokens, place.astype("<u2"), n, sums


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    bucket, block, a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), _binary(a), _binary(b), _binary(c)],
        ["bucket", "block", "a", "b", "c"],
    )


def _pieces(batches: Iterator[pa.RecordBatch], bytes_each: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to blocks, or blocks to slices."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        upto, start = np.cumsum(size), 0
        while start < len(size):
            done = upto[start] - size[start]
            stop = max(start + 1, int(np.searchsorted(upto, done + bytes_each, "right")))
            stop = min(stop, start + MOST_DOCS)
            yield batch.slice(start, stop - start)
            start = stop


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.compute.fill_null(texts, "")
    texts = pa.concat_arrays([texts])
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64)


def _sets(block: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``distinct`` of the shingles of a block's texts, of which only a slice is spread out to words at a time."""
    found, docs = [], 0
    for part in _pieces([block], SLICE):
        tokens, owner, n, sums = distinct(*shingles(*word_hashes(*_flat(part.column(1))), words), len(part))
        found.append((tokens, owner + np.uint16(docs), n, sums))
        docs += len(part)
    tokens, owner, n, sums = (np.concatenate(values, axis=-1) for values in zip(*found))
    del found
    # Slices are in the order of documents, so those with the same token stay in it.
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order], n, sums


def _tails(keys: np.ndarray) -> np.ndarray:
    """The bytes of each key that its bucket does not tell."""
    return np.ascontiguousarray(keys).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN]


def _by_bucket(keys: np.ndarray, values: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, values, tails) of the buckets that ascending ``keys`` fall in."""
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    tails = _tails(keys)
    for bucket in np.nonzero(np.diff(cuts))[0].tolist():
        part = slice(cuts[bucket], cuts[bucket + 1])
        yield bucket, values[part].tobytes(), tails[part].tobytes()


def _cut(words: int, bits: int):
    """Rows (bucket, block, a, b, c): of tokens with few owners in the block, owners and tails in a and b; of crowded
    ones, tails and numbers of owners in b and c; below zero the block's own row, with all its documents and crowds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        edges = np.arange(1, 1 << bits, dtype=U) << U(8 * TOKEN)
        for number, piece in enumerate(_pieces(batches, BLOCK)):
            block = task << 32 | number
            tokens, owner, n, sums = _sets(piece, words)
            ids = piece.column(0)
            about = np.zeros((5, len(piece)), np.int64)
            about[0] = pa.compute.fill_null(ids, 0).to_numpy()
            about[1] = pa.compute.is_null(ids).to_numpy(zero_copy_only=False)
            about[2], about[3:] = n, sums.view(np.int64)
            keys = tokens >> U(64 - bits - 8 * TOKEN)
            del tokens
            starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, int)
            members = np.diff(np.append(starts, len(keys)))
            many = members >= CROWD
            crowded = np.repeat(many, members)
            crowds, sizes = keys[starts[many]], members[many].astype("<u4")
            home = -1 - int(_mix(np.array([block], U))[0] >> U(64 - bits))
            known = sizes.tobytes() + owner[crowded].tobytes()
            rows = [(home, block, about.tobytes(), crowds.astype("<u8").tobytes(), known)]
            for bucket, owners, tails in _by_bucket(keys[~crowded], owner[~crowded], edges):
                rows.append((bucket, block, owners, tails, None))
            for bucket, held, tails in _by_bucket(crowds, sizes, edges):
                rows.append((bucket, block, None, tails, held))
            yield _packed(rows)

    return run


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // TOKEN, 8), np.uint8)
    wide[:, :TOKEN] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN)
    return wide.view("<u8").ravel()


def _count(rows: pa.Table) -> pa.Table:
    """Of a bucket's tokens those that several documents hold, with that number, by block."""
    bucket = rows["bucket"][0].as_py()
    if bucket < 0 or not rows.num_rows:
        return rows
    blocks, owners, packed, crowds = (rows[name].to_pylist() for name in ("block", "a", "b", "c"))
    size = np.array([len(tails) // TOKEN for tails in packed])
    tokens = _unpacked(b"".join(packed))
    # Of a crowd, how many hold the token stands for an owner.
    owner = np.concatenate(
        [np.frombuffer(c, "<u4") if a is None else np.frombuffer(a, "<u2").astype("<u4") for a, c in zip(owners, crowds)]
    )
    crowded = np.repeat([a is None for a in owners], size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner, crowded = tokens[order], owner[order], crowded[order]
    of = np.repeat(np.arange(len(size)), size)[order]
    starts = np.nonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))[0]
    held = np.add.reduceat(np.where(crowded, owner, 1).astype(np.int64), starts)
    held = np.repeat(np.minimum(held, 65535), np.diff(np.append(starts, len(tokens)))).astype("<u2")
    shared = held > 1
    tokens, owner, of, held = tokens[shared], owner[shared], of[shared], held[shared]
    order = np.argsort(of, kind="stable")
    tokens, owner, of, held = tokens[order], owner[order], of[order], held[order]
    tails, owner = _tails(tokens), owner.astype("<u2")
    found, cuts = [], np.searchsorted(of, np.arange(len(size) + 1))
    for at in np.nonzero(np.diff(cuts))[0].tolist():
        part = slice(cuts[at], cuts[at + 1])
        who = None if owners[at] is None else owner[part].tobytes()
        found.append((bucket, blocks[at], who, tails[part].tobytes(), held[part].tobytes()))
    return pa.Table.from_batches([_packed(found)] if found else [], rows.schema)


def _regroup(percent: int):
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("t", pa.int64()), ("tokens", pa.binary()), ("held", pa.binary())]
    )

    def run(rows: pa.Table) -> pa.Table:
        bucket = np.array(rows["bucket"].to_pylist())
        a, b, c = (rows[name].to_pylist() for name in ("a", "b", "c"))
        (head,) = np.nonzero(bucket < 0)[0]
        about = np.frombuffer(a[head], np.int64).reshape(5, -1)
        n = about[2]
        order = [at for at in np.argsort(bucket, kind="stable").tolist() if bucket[at] >= 0]

        def joined(parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
            held = np.frombuffer(b"".join(c[at] for at in parts), "<u2")
            tokens = _unpacked(b"".join(b[at] for at in parts))
            above = np.repeat(bucket[parts], [len(c[at]) // 2 for at in parts]).astype(U) if parts else tokens
            return tokens | (above << U(8 * TOKEN)), held

        few = [at for at in order if a[at] is not None]
        tokens, held = joined(few)
        owner = np.frombuffer(b"".join(a[at] for at in few), "<u2")
        crowds, by = joined([at for at in order if a[at] is None])
        by = by[np.argsort(crowds)]
        # All crowds come back; the block's own row has them in the same order.
        crowds = np.frombuffer(b[head], "<u8")
        sizes = np.frombuffer(c[head], "<u4", len(crowds))
        tokens = np.concatenate([tokens, np.repeat(crowds, sizes)])
        held = np.concatenate([held, np.repeat(by, sizes)])
        owner = np.concatenate([owner, np.frombuffer(c[head], "<u2", offset=4 * len(crowds))])
        order = np.lexsort((tokens, held, owner))
        tokens, held, owner = tokens[order], held[order], owner[order]
        shared = np.bincount(owner, minlength=len(n))
        shortest = n - -(-percent * n // 100) + 1
        open_docs = (n - shared < shortest) & (n > 0)
        cuts = np.searchsorted(owner, np.arange(len(n) + 1))
        some = [None] * len(n)
        often = list(some)
        for doc in np.nonzero(open_docs)[0].tolist():
            part = slice(cuts[doc], cuts[doc + 1])
            some[doc], often[doc] = tokens[part].tobytes(), held[part].tobytes()
        ids = pa.array(about[0], mask=about[1].astype(bool))
        return pa.table(
            [ids, pa.array(n), pa.array(about[3]), pa.array(about[4]), _binary(some), _binary(often)], schema=schema
        )

    return run


def bucket_bits(size: int, tasks: int) -> int:
    """Bits of a bucket's number, for so many bytes of text and tasks."""
    buckets = max(2 * tasks, (2 + TOKEN) * size // 4 // BUCKET + 1)
    return min(max(5, (buckets - 1).bit_length()), MOST_BITS)


def shingle_sets(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(id, n, s, t, tokens, held): each document's number of tokens and two sums over its set; of those
    that may link, the tokens other documents hold too, rarest first, and how many hold each."""
    spark = docs.sparkSession
    rows = docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text"))
    bits = bucket_bits(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, partitions(spark))
    cut = rows.mapInArrow(_cut(words, bits), _PACKED)
    counted = cut.groupBy("bucket").applyInArrow(_count, _PACKED)
    schema = "id long, n long, s long, t long, tokens binary, held binary"
    return stored(counted.groupBy("block").applyInArrow(_regroup(percent), schema), "shingle-sets")


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, n, tokens, held = (batch.column(i).to_pylist() for i in range(4))
            match, first, central, posted = [], [], [], []
            for size, packed, often in zip(n, tokens, held):
                token, cost = np.frombuffer(packed, np.int64), np.frombuffer(often, "<u2").astype(float)
                own = size - len(token)
                shortest = size - -(-percent * size // 100) + 1 - own
                longest = min(shortest + LONGEST - 1, len(token))
                spent = np.cumsum(cost)[shortest - 1 : longest]
                matches = np.arange(1, len(spent) + 1)
                # With l matches needed, at most a share 1/l of the postings end as candidates.
                best = int(np.argmin(spent + VERIFY * len(token) * spent / matches)) + 1
                match.append(best)
                first.append(own)
                central.append((own + cost.sum()) / size)
                posted.append(token[: shortest + best - 1])
            arrays = [
                pa.array(uid, pa.int64()), pa.array(n, pa.int64()), pa.array(match, pa.int32()),
                pa.array(first, pa.int64()), pa.array(central, pa.float64()), pa.array(posted, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "n", "match", "first", "central", "posted"])

    return run


def _allowed(x: str, y: str, percent: int) -> Column:
    """Whether places and sizes of a shared token allow a link; ``x`` and ``y`` are structs."""

    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    both = of(x, "n") + of(y, "n")
    need = F.floor((percent * both + (100 + percent - 1)) / (100 + percent))
    extra = F.least(of(x, "match"), of(y, "match")) - 1
    fits = F.lit(True)
    for side in (x, y):
        fits &= (need <= of(side, "n")) & (of(side, "place") <= of(side, "n") - need + extra)
    return fits


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n, x, y = (batch.column(i).to_pylist() for i in range(6))
            linked = []
            for at in range(len(a)):
                one, other = np.frombuffer(x[at], "<u8"), np.frombuffer(y[at], "<u8")
                common = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * common >= percent * (m[at] + n[at] - common))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that link."""
    sets = sets.select("uid", "n", "tokens")
    for end, size, tokens in (("a", "m", "x"), ("b", "n", "y")):
        side = sets.select(F.col("uid").alias(end), F.col("n").alias(size), F.col("tokens").alias(tokens))
        pairs = pairs.join(side, end)
    pairs = pairs.select("a", "b", "m", "n", "x", "y")
    return stored(pairs.mapInArrow(_verified(percent), "a long, b long"), name)


def _ends(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.uid", f"{y}.uid").alias("a"), F.greatest(f"{x}.uid", f"{y}.uid").alias("b")]


def _central_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Each list's members with two of them, chosen alike in all lists: the most central, and one by hash."""
    # The set whose tokens most others hold is most like the text that the others vary.
    central = F.max_by("x", F.struct("x.central", F.xxhash64("x.uid")))
    other = F.min_by("x", F.xxhash64("x.uid", F.lit(1)))
    centres = posts.groupBy("token").agg(F.count("*").alias("members"), central.alias("c0"), other.alias("c1"))
    centres = centres.where("members > 1")
    met = posts.join(centres, "token")
    met = met.select("x", F.explode(F.array_distinct(F.array("c0", "c1"))).alias("y"))
    met = met.where((F.col("x.uid") != F.col("y.uid")) & _allowed("x", "y", percent))
    return met.select(*_ends("x", "y")).distinct()


def _other_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share enough posted tokens."""
    parts = posts.groupBy("token", "part").agg(F.count("*").alias("members"))
    lists = parts.groupBy("token").agg(
        F.max_by("part", F.struct("members", "part")).alias("largest"), F.count("*").alias("parts")
    )
    mixed = posts.join(lists.where("parts > 1"), "token").drop("parts")
    mixed = mixed.withColumn("out", F.col("part") != F.col("largest"))
    y = mixed.select("token", F.col("x").alias("y"), F.col("part").alias("other"), F.col("out").alias("y_out"))
    met = mixed.where("out").join(y, "token").where(
        (F.col("part") != F.col("other"))
        & (~F.col("y_out") | (F.col("x.uid") < F.col("y.uid")))
        & _allowed("x", "y", percent)
    )
    pairs = met.groupBy(*_ends("x", "y")).agg(
        F.count("*").alias("shared"), F.max(F.least("x.match", "y.match")).alias("needed")
    )
    return pairs.where("shared >= needed").select("a", "b")


def similar_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of linked sets. ``sets``: uid, n, tokens, held, all with tokens."""
    schema = "uid long, n long, match int, first long, central double, posted array<long>"
    posts = sets.select("uid", "n", "tokens", "held").mapInArrow(_prefixes(percent), schema)
    posts = posts.select("uid", "n", "match", "first", "central", F.posexplode("posted").alias("at", "token"))
    member = F.struct("uid", "n", "match", "central", (F.col("first") + F.col("at")).alias("place"))
    posts = stored(posts.select("token", member.alias("x")), "postings")
    links = _verify(_central_pairs(posts, percent), sets, percent, "central-links")
    release(sets.sparkSession)
    roots = components(links)
    part = F.coalesce("root", "x.uid").alias("part")
    posts = posts.join(roots, F.col("x.uid") == F.col("node"), "left").select("token", "x", part)
    more = _verify(_other_pairs(posts, percent), sets, percent, "other-links")
    release(sets.sparkSession)
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(joined.unionByName(more)) if not more.isEmpty() else roots


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``."""
    rows = shingle_sets(docs, key, text, words, percent)
    release(docs.sparkSession)
    sets = rows.where("n > 0").groupBy("n", "s", "t").agg(
        F.min("id").alias("least"), F.first("tokens", True).alias("tokens"), F.first("held", True).alias("held")
    )
    sets = stored(sets.withColumn("uid", F.monotonically_increasing_id()), "distinct-sets")
    roots = similar_sets(sets.where("tokens IS NOT NULL"), percent)
    known = sets.select("n", "s", "t", "least", "uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    known = known.withColumn("root", F.coalesce("root", "uid"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select("n", "s", "t", "component_id")
    found = rows.select("id", "n", "s", "t").join(known, ["n", "s", "t"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
