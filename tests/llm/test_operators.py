"""Each operator against a brute-force version, and on awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import chat, content_sort, cube, huffman, jaccard, merges, perplexity, ppm, queries, sharding, tiles
from jobtrail.llm import components as component_rounds
from jobtrail.llm.components import components

WHITE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [word for word in WHITE.split(text or "") if word]


def find(parents, node):
    while parents[node] != node:
        node = parents[node]
    return node


def join(parents, a, b):
    a, b = sorted((find(parents, a), find(parents, b)))
    parents[b] = a


def prose(rng, n, vocabulary="the of and to in a is that it was for on are with as his they be at one".split()):
    return [rng.choice(vocabulary) + rng.choice(("", "s", "ed", "ing", "ly")) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    """Awkward texts and groups of copies and near copies around a hot one."""
    rng = random.Random(7)
    texts = [None, "", " ", "\n\t", "one", "One", "one two", "a b c d", "A  b\tc d", "é ü ß", "é ü ß", "x" * 50_000]
    base = prose(rng, 120)
    for _ in range(90):
        near = list(base)
        for _ in range(rng.randrange(9)):
            near[rng.randrange(len(near))] = rng.choice(("zebra", "quagga", "okapi")) + str(rng.randrange(99))
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 40 + ["\n".join(base)] * 3 + ["  ".join(base).upper()] * 2
    shared = prose(rng, 60)
    texts += [" ".join(prose(rng, 60) + shared) for _ in range(40)]
    texts += [" ".join(prose(rng, rng.randrange(1, 300))) for _ in range(60)]
    rng.shuffle(texts)
    rows = []
    for number, text in enumerate(texts):
        lang = rng.choice(("en", "en", "de", None))
        rows.append((number, text, lang, rng.choice(("s1", "s1", "s1", "s2", "s3", None))))
    return rows


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame(docs, DOCS).repartition(5, "doc_id")


def clashing(df):
    """Extra columns with names that operators might use themselves."""
    names = "dedup quality code head norm order sha number times other which one size shard links root body ids given"
    return df.withColumns({name: F.lit(name) for name in (*names.split(), "a.b", "text_sha256")})


# --- 1 ---


def linked_documents(rows, percent=75, size=5):
    sets = {}
    for key, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        sets[key] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parents = {key: key for key in sets}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                join(parents, a, b)
    return {(key, len(sets[key]), find(parents, key)) for key in keys}


@pytest.mark.parametrize("percent", [75, 50])
def test_similar_documents(table, docs, percent):
    got = jaccard.similar_documents(clashing(table), percent=percent).collect()
    assert {tuple(row) for row in got} == linked_documents(docs, percent)
    assert len(got) == len(docs)


def test_prefixes_of_any_length_lose_no_link(table, docs, monkeypatch):
    for longest, verify in ((1, 0.0), (16, 1000.0)):
        monkeypatch.setattr(jaccard, "LONGEST", longest)
        monkeypatch.setattr(jaccard, "VERIFY", verify)
        got = jaccard.similar_documents(table).collect()
        assert {tuple(row) for row in got} == linked_documents(docs)


def common_passage(number, common=9):
    """Documents that share a passage, with five words more of their own, some of which others have too."""
    rng = random.Random(7)
    shared = " ".join(prose(rng, common))
    rows = []
    for key in range(number):
        own = " ".join(f"w{rng.randrange(3)}" for _ in range(rng.choice((1, 2, 12))))
        rows.append((key, f"{shared} {own}", "en", "s"))
    return rows


@pytest.mark.parametrize("crowd", [2, 4, 10_000])
def test_crowds_of_blocks_lose_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)
    monkeypatch.setattr(jaccard, "BUCKET", 1_000)
    rows = common_passage(200)
    got = jaccard.similar_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {tuple(row) for row in got} == linked_documents(rows)


def test_a_shingle_of_all_documents_is_sent_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)
    table = spark.createDataFrame(common_passage(600), DOCS).select("doc_id", "text").repartition(3)
    sent = table.mapInArrow(jaccard._cut(5, 5), jaccard._PACKED).collect()
    blocks = {row.block for row in sent}
    assert len(blocks) > 12
    entries = {}
    for row in sent:
        tails = row.b if row.bucket >= 0 else b""
        for at in range(0, len(tails), jaccard.TOKEN):
            key = row.bucket, bytes(tails[at : at + jaccard.TOKEN])
            entries.setdefault(key, []).append(row.block)
    # The five shingles of the passage are in every document, once a block but where a block has fewer than a crowd.
    small = sum(len(row.a) // 40 < jaccard.CROWD for row in sent if row.bucket < 0)
    everywhere = [found for found in entries.values() if set(found) == blocks]
    assert small <= 3
    assert sum(len(found) <= len(blocks) + small * (jaccard.CROWD - 2) for found in everywhere) >= 5
    assert all(found.count(block) < jaccard.CROWD for found in entries.values() for block in set(found))
    # The blocks' own rows are dealt like the others.
    assert len({row.bucket for row in sent if row.bucket < 0}) > len(blocks) / 3


def test_more_text_gives_more_buckets():
    assert jaccard.bucket_bits(0, 4) == 5
    assert jaccard.bucket_bits(0, 1000) == 11
    assert 2 ** jaccard.bucket_bits(30 << 30, 4) * jaccard.BUCKET >= 30 * 7 / 4 * 2**30
    assert jaccard.bucket_bits(1 << 60, 4) == jaccard.MOST_BITS


def test_long_words_are_hashed_whole():
    texts = ["a" * 1000, "a" * 1001, "a" * 999 + "b", "b" + "a" * 999, "aA aa", "ab\x0b ab", "\x1c"]
    data = [text.encode() for text in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    hashes, count = jaccard.word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert count.tolist() == [1, 1, 1, 1, 2, 2, 1]
    assert len(set(hashes[:4].tolist())) == 4
    assert hashes[4] == hashes[5] and hashes[6] == hashes[7]


def test_similar_documents_repeated_and_null_ids(spark):
    text = " ".join(prose(random.Random(1), 30))
    rows = [(None, text, "en", "s"), (5, text, "en", "s"), (5, text, "en", "s"), (3, None, None, None)]
    got = jaccard.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    n = len({tuple(words(text)[i : i + 5]) for i in range(26)})
    assert sorted(map(str, got)) == sorted(
        f"Row(doc_id={key}, n_shingles={n if key != 3 else 0}, component_id={key or 5})" for key in (None, 5, 5, 3)
    )


@pytest.mark.parametrize("few", [200_000, 30])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(component_rounds, "FEW", few)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(300)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, None), (9999, 9999)]
    parents = {node: node for edge in edges for node in edge if node is not None}
    for a, b in edges:
        if b is not None:
            join(parents, a, b)
    got = {tuple(row) for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(node, find(parents, node)) for node in parents if node != 9999}


# --- 2 ---


def linked_vectors(rows, threshold=0.98):
    parents, links = {key: key for key, *_ in rows}, Counter()
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[:i]:
            if p is None or p != q or not x or not y or len(x) != len(y) or None in x or None in y:
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            if not (np.isfinite(x_).all() and np.isfinite(y_).all() and x_.any() and y_.any()):
                continue
            if (x_ * y_).sum() / (np.sqrt((x_ * x_).sum()) * np.sqrt((y_ * y_).sum())) >= threshold:
                links[a] += 1
                links[b] += 1
                join(parents, a, b)
    return {(key, links[key], find(parents, key), find(parents, key) == key) for key, *_ in rows}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows, centre = [], rng.normal(size=(6, 24))
    for key in range(300):
        vector = centre[key % 6] + rng.normal(size=24) * (0.0, 0.15, 0.19, 0.5)[key % 4]
        rows.append([float(np.float32(x)) for x in vector * (1, 1000, 1e-20)[key % 3]])
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 23]
    rows += odd + odd + [rows[0]] * 50
    return [(key, vector, (1, 1, 2, None)[key % 4]) for key, vector in enumerate(rows)]


def test_near_duplicates(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    # One block a label; blocks in squares of one; in squares of up to three.
    for block, side in ((1 << 18, 8), (24 * 16, 8), (24 * 4, 3)):
        monkeypatch.setattr(tiles, "BLOCK", block)
        monkeypatch.setattr(tiles, "SIDE", side)
        got = tiles.near_duplicates(clashing(df)).collect()
        assert len(got) == len(vectors)
        assert {tuple(row) for row in got} == linked_vectors(vectors)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 50)) * rng.exponential(size=(200, 1))
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    code, step, error = tiles.quantise(unit)
    rough = tiles._dots(code, code) * step[:, None] * step[None]
    bound = error[:, None] * (1 + error[None]) + error[None] + tiles.ROUNDING
    assert (np.abs(unit @ unit.T - rough) <= bound).all()
    assert np.abs(code).max() <= 127


# --- 3 ---


def test_shards(table, docs):
    got = sharding.shard_documents(clashing(table), shards=4).collect()
    text_of = {key: text for key, text, *_ in docs}
    slots, loads, places = defaultdict(list), Counter(), defaultdict(set)
    for row in got:
        data = (text_of[row.doc_id] or "").encode()
        assert (row.size, row.text_crc32) == (len(data) + 8, zlib.crc32(data))
        slots[row.shard].append(row.slot)
        loads[row.shard] += row.size
        places[text_of[row.doc_id]].add(row.shard)
    assert len(got) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(row.size for row in got)
    assert max(loads.values()) - min(loads[s] for s in range(4)) <= largest


def test_shards_keep_small_groups_together(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(prose(rng, 40)), "en", "s") for i in range(900)]
    rows += [(900 + i, rows[i // 2][1], "en", "s") for i in range(200)]
    shards = defaultdict(set)
    for row in sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards=4).collect():
        shards[rows[row.doc_id][1]].add(row.shard)
    linked = [shards[rows[i][1]] for i in range(100)]
    assert sum(len(found) > 1 for found in linked) <= 5


# --- 4 ---


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    return merges.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def awkward_texts():
    rng = random.Random(3)
    texts = ["", " ", "  ", "   a", "a ", "▁", "a▁ b", "\x00", "\n\n", "<s> </s> <unk> <0x41>", "👍🏽 ok", "日本語の文章です。"]
    texts += ["a" * 3000, "ab" * 2000, " " * 1000, "=" * 77 + "-" * 33, "ＡＢＣ ſß", "͸\U0010ffff", "<|endoftext|> it's", "é́ İΣ"]
    alphabet = " ab\n▁é.e日tnThinge  1=-_/'"
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]


def test_merges_equal_the_library(pieces):
    tables, library = pieces
    texts = awkward_texts()
    ids, count = merges.encode_texts(merges.Words(tables), texts)
    data, length = merges.decode_ids(tables, ids, count)
    ends, stops = np.cumsum(count), np.cumsum(length)
    for text, start, end, first, last in zip(texts, ends - count, ends, stops - length, stops):
        expected = library.encode(text)
        assert ids[start:end].tolist() == expected, repr(text)
        assert data.tobytes()[first:last].decode() == library.decode(expected)


def test_words_are_forgotten_when_full(pieces, monkeypatch):
    tables, library = pieces
    monkeypatch.setattr(merges, "WORDS", 10)
    known = merges.Words(tables)
    for text in awkward_texts()[-40:]:
        ids, _ = merges.encode_texts(known, [text, None])
        assert ids.tolist() == library.encode(text)


def test_encode_documents(table, docs, pieces):
    tables, library = pieces
    found = merges.decode(merges.encode(clashing(table), tables), tables, ids="ids_")
    assert "ids" in found.columns
    for row in found.collect():
        expected = library.encode(docs[row.doc_id][1] or "")
        assert row.ids_ == expected and row.decoded == library.decode(expected)


# --- 5 ---


def whole_model(counts):
    """The model in one shard, each half scored by its own."""
    return perplexity.shard(*perplexity.model(counts), 0, 1, {0: 0, 1: 1})


def test_kneser_ney_sums_to_one(table, docs):
    counts = perplexity.window_counts(table, "text").collect()
    found = whole_model(table.sparkSession.createDataFrame(counts))
    contexts = sorted({(row.half << perplexity.HALF | row.code) >> perplexity.BITS for row in counts})
    for context in random.Random(2).sample(contexts, 20):
        chance = np.exp2(-found.bits((context << perplexity.BITS) + np.arange(perplexity.SIGNS)))
        assert chance.sum() == pytest.approx(1, abs=1e-4)


def test_kneser_ney_equals_a_slow_version(table, docs):
    order, width = perplexity.ORDER, perplexity.BITS
    got = perplexity.window_counts(table, "text").collect()
    halves = {row.doc_id: row.half for row in table.select("doc_id", perplexity._half(F.col("text")).alias("half")).collect()}
    counted = Counter()
    for key, text, *_ in docs:
        # Windows by hand: five signs up to each one.
        line = perplexity.folded(text)
        points = [0] * (order - 1) + [c if c < 768 else 768 + c % 256 for c in map(ord, line)]
        counted.update((halves[key], tuple(points[i : i + order])) for i in range(len(line)))

    def code(window):
        return sum(sign << width * (len(window) - 1 - i) for i, sign in enumerate(window))

    assert {(row.half, row.code, row.n) for row in got} == {(half, code(w), n) for (half, w), n in counted.items()}
    found = whole_model(table.sparkSession.createDataFrame(got))
    orders = {half: [{w: n for (h, w), n in counted.items() if h == half}] for half in (0, 1)}
    for half in orders:
        for _ in range(order - 1):
            orders[half].append(Counter(window[1:] for window in orders[half][-1]))

    def chance(half, window):
        if not window:
            return 1 / perplexity.SIGNS
        counts = orders[half][order - len(window)]
        n1, n2, n3, n4 = (sum(n == k for n in counts.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else 0
        take = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3) if y else (0.5,) * 3
        take = [min(max(d, 0), k) for k, d in enumerate(take, 1)]
        same = {w: n for w, n in counts.items() if w[:-1] == window[:-1]}
        if not same:
            return chance(half, window[1:])
        total, off = sum(same.values()), sum(take[min(n, 3) - 1] for n in same.values())
        n = same.get(window, 0)
        if not n:
            return max(off / total, perplexity.LEAST) * chance(half, window[1:])
        return (n - take[min(n, 3) - 1]) / total + off / total * chance(half, window[1:])

    rng = random.Random(1)
    seen = rng.sample(sorted(counted), 25)
    seen += [(half, (*window[:-1], rng.randrange(97, 122))) for half, window in seen[:10]]
    seen += [(rng.randrange(2), tuple(rng.randrange(97, 122) for _ in range(order))) for _ in range(15)]
    bits = found.bits(np.array([half << perplexity.HALF | code(window) for half, window in seen]))
    assert bits == pytest.approx([-np.log2(chance(*window)) for window in seen], rel=2e-3)


def test_repeated_words_are_one_sign():
    assert perplexity.folded("a b  a\nc d e f a") == " a b\x01 c d e f a"
    assert perplexity.folded(None) == perplexity.folded(" \t") == ""


def test_shards_add_up(table, docs, monkeypatch):
    labels = table.sparkSession.createDataFrame([(n, 1, 0) for n in range(0, len(docs), 2)], "doc_id long, quality int, toxic int")
    one = {row.doc_id: row.quality for row in perplexity.judged(table, labels).select("doc_id", "quality").collect()}
    monkeypatch.setattr(perplexity, "SHARD", 4000)
    good = perplexity.trusted_texts(table, labels, "doc_id", "text", "lang")
    assert len(perplexity.fitted(good)) > 2
    many = perplexity.judged(clashing(table), labels)
    assert many.columns == [*clashing(table).columns, "quality_"]
    rows = many.select("doc_id", "quality_").collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert list(row.quality_) == pytest.approx(list(one[row.doc_id]), rel=1e-6)


def test_quality_sees_more_than_letters(spark):
    """Trusted English texts, altered: what is no prose any more goes, and what was not altered stays."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    good = docs.where("lang = 'en'").join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    rng = random.Random(3)
    changes = {
        "digits": lambda text: "".join(c if c.isspace() else rng.choice("0123456789") for c in text),
        "shuffled": lambda text: " ".join(rng.sample(text.split(), len(text.split()))),
        "alternating": lambda text: " ".join((text.split() * 2)[i % 2] for i in range(len(text.split()))),
        "capitals": lambda text: "".join(c if c.isspace() else rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in text),
        "same": lambda text: text,
    }
    rows, kind = [], {}
    for row in good.orderBy("doc_id").collect():
        for name, change in changes.items():
            key = 1_000_000 + len(rows)
            kind[key] = name
            rows.append((key, change(row.text), "en", "s"))
    more = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, DOCS))
    found = perplexity.accepted(more, labels)
    kept = Counter(kind[row.doc_id] for row in found.select("doc_id").collect() if row.doc_id in kind)
    n = len(rows) / len(changes)
    assert n > 200
    assert kept["same"] >= 0.98 * n
    assert all(kept[name] <= 0.05 * n for name in changes if name != "same"), kept


def test_quality_keeps_clean_and_drops_junk(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = clashing(docs).transform(lambda df: perplexity.judged(df, labels)).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    found = Counter((row.label, row.quality_.accepted) for row in judged.select("label", "quality_").collect())
    assert found[1, False] == 0 and found[0, True] <= 2 and found[0, False] > 50
    assert perplexity.accepted(docs, labels).columns == docs.columns


def test_quality_without_trust_accepts_all(table, docs):
    labels = table.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert perplexity.accepted(table, labels).count() == len(docs)


def test_quality_counts_all_trusted_texts(spark, monkeypatch):
    """Nothing bounds the number of trusted documents, and their ids join without a forced broadcast."""
    monkeypatch.setattr(perplexity, "TRUSTED", 3, raising=False)
    if most := perplexity.trusted_ids.__defaults__:
        monkeypatch.setattr(perplexity.trusted_ids, "__defaults__", (3,) * len(most))
    labels = spark.createDataFrame([(i % 40, 1, 0) for i in range(80)] + [(50, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ids = perplexity.trusted_ids(labels)
    assert sorted(row.trusted for row in ids.collect()) == list(range(40))
    assert "broadcast" not in ids._jdf.queryExecution().logical().toString().lower()
    words = ["alpha beta gamma", "delta omega sigma"]
    docs = spark.createDataFrame([(i, " ".join(words[i % 2 : i % 2 + 1] * 3), "en", "s") for i in range(40)], DOCS)
    rows = perplexity.judged(docs, labels).select("doc_id", "quality.*").collect()
    assert len(rows) == 40 and all(row.accepted for row in rows)


def test_quality_of_rare_languages(spark):
    """A language with few trusted texts among many of another one has a limit of its own."""
    rng = random.Random(5)
    rare = "ženščina gžel štšuka żółw čtvrtek ďábel příliš kůň úpěl qoqod xhosa wqyz".split()
    rows = [(i, " ".join(prose(rng, 60)), "en", "s") for i in range(300)]
    rows += [(300 + i, " ".join(rng.choice(rare) + rng.choice("xyzwq") for _ in range(60)), "xx", "s") for i in range(8)]
    rows += [(400, " ".join(prose(rng, 60)), "yy", "s"), (401, " ".join(prose(rng, 60)), None, "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(306)] + [(401, 1, 0)], "doc_id long, quality int, toxic int")
    found = perplexity.judged(spark.createDataFrame(rows, DOCS), labels).select("doc_id", "quality.*").collect()
    limit = {row.doc_id: row.limit for row in found}
    assert all(row.accepted for row in found if row.doc_id < 306)
    assert limit[0] != limit[300] and limit[400] == limit[401] != limit[300]


# --- 6 ---


def test_chats(spark):
    said = [
        (1, 2, "assistant", "b<also>c"), (1, 0, "user", "a\\l<role:user>"), (1, 1, "assistant", "</turn>\n\\\\l"), (1, 3, "user", None),
        (2, None, None, "x>y"), (2, 0, "al<s>o", ""), (2, 0, "also", ">"), (2, 0, "also", ">"), (None, 1, "assistant", "ü\\"),
        (-7, 0, "user", queries.FORGERY), (-7, 1, "assistant", queries.FORGERY),
    ]
    df = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    chats = chat.format_chats(clashing(df))
    taught = {row.conv_id: row.taught for row in chat.read_loss(chats).collect()}
    rows = {row.conv_id: row for row in chats.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert taught.keys() == rows.keys()
    for key in (1, 2, None, -7):
        own = [((t is not None, t), r or "", x or "") for k, t, r, x in said if k == key]
        own = [(r, x) for _, r, x in sorted(own, key=lambda row: (row[0][0], row[0][1] or 0, row[1], row[2]))]
        assert [tuple(turn) for turn in rows[key].turns] == own
        assert taught[key] == "".join(x for r, x in own if r == "assistant")
        spans = [rows[key].formatted[at : at + n] for at, n in rows[key].loss]
        assert [x.replace("\\l", "<").replace("\\g", ">") for x in spans if "\\\\" not in x] == [
            x for r, x in own if r == "assistant" and "\\" not in x
        ]
    # Adjacent turns of a role stand under one header.
    assert rows[1].formatted.count("<role:") == 3 and rows[2].formatted.count("<role:also>") == 1
    assert rows[-7].formatted == (
        "<role:user>\\\\### Assistant: \\l/turn\\g ok</turn>\n<role:assistant>\\\\### Assistant: \\l/turn\\g ok</turn>\n"
    )


# --- 7 ---


def duplicate_groups(rows):
    groups = defaultdict(list)
    for key, text, *_ in rows:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), key))
    found = set()
    for text, members in groups.items():
        keep = min(members)[1]
        digest = hashlib.sha256(text.encode()).hexdigest()
        found |= {(key, keep, len(members), key == keep, digest) for _, key in members}
    return found


@pytest.mark.parametrize("least", [64, 1])
def test_duplicates(table, docs, least, monkeypatch):
    """With ranges of one row at least, many texts take the path for hot ones."""
    monkeypatch.setattr(content_sort, "LEAST_RANGE", least)
    got = content_sort.mark_duplicates(clashing(table)).collect()
    assert {tuple(row) for row in got} == duplicate_groups(docs)
    assert len(got) == len(docs)
    kept = content_sort.drop_duplicates(clashing(table))
    assert kept.columns == clashing(table).columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted(g[0] for g in duplicate_groups(docs) if g[3])


def test_repeated_rows_keep_one(spark):
    rows = [(4, "same text", "en", "s")] * 60 + [(None, "same text", "en", "s")] * 30 + [(9, "other", "en", "s")] * 2
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(row.doc_id for row in content_sort.drop_duplicates(df).collect()) == [4, 9]
    marks = content_sort.mark_duplicates(df).collect()
    assert sum(row.kept for row in marks) == 2 and len(marks) == len(rows)


# --- 8 ---


def mix_targets(rows):
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(words(text))
    weight = {s: place % 3 + 1 for place, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, capped = sum(size.values()), set()
    while True:
        rate = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and weight[s] * rate > 3 * size[s]}
        if not more:
            return size, {s: 3 * size[s] if s in capped else weight[s] * rate for s in size}
        capped |= more


def test_mix(table, docs, monkeypatch):
    size, target = mix_targets(docs)
    for block in (4096, 16):
        monkeypatch.setattr(cube, "BLOCK", block)
        got = cube.mix(clashing(table)).collect()
        assert len(got) == len(docs)
        taken = Counter()
        for row in got:
            assert row.size == len(words(docs[row.doc_id][1])) and 0 <= row.times <= 3
            assert row.source == docs[row.doc_id][3]
            assert row.source_size == size[row.source] and row.target == pytest.approx(target[row.source])
            taken[row.source] += row.times * row.size
        assert {s: taken[s] - target[s] for s in size if abs(taken[s] - target[s]) > 100} == {}
        again = cube.mix(table.repartition(3)).collect()
        assert {(r.doc_id, r.times) for r in got} == {(r.doc_id, r.times) for r in again}


def test_mixed_documents(table, docs):
    times = {row.doc_id: row.times for row in cube.mix(table).collect()}
    mixed = cube.mixed_documents(clashing(table))
    assert mixed.columns == clashing(table).columns
    assert Counter(row.doc_id for row in mixed.collect()) == Counter({k: n for k, n in times.items() if n})


def test_flight_keeps_both_totals():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 500) for _ in range(1000)]
    chances = [0.37] * 1000
    left = cube.flight(sizes, chances, [rng.random() for _ in sizes])
    assert len(left) <= 2
    assert sum(chances) == pytest.approx(370, abs=1e-3)
    assert sum(s * c for s, c in zip(sizes, chances)) == pytest.approx(0.37 * sum(sizes), rel=1e-6)


# --- 9 ---


def test_context_trees_equal_a_slow_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    counted = Counter()
    for row in rows[:80]:
        data = b"\0\0\0" + row.text.lower().encode()
        counted.update((row.lang, int.from_bytes(data[i - 3 : i + 1], "big")) for i in range(3, len(data)))
    langs, codes = zip(*counted)
    trees = ppm.grow(list(langs), np.array(codes), np.array(list(counted.values())))
    follow = {lang: [defaultdict(Counter) for _ in range(4)] for lang in trees.languages}
    for (lang, code), n in counted.items():
        window = code.to_bytes(4, "big")
        for order in range(4):
            follow[lang][order][window[3 - order : 3]][window[3]] += n

    def cost(lang, window):
        bits = 0
        for order in (3, 2, 1, 0):
            seen = follow[lang][order].get(window[3 - order : 3])
            if seen:
                total = sum(seen.values()) + len(seen)
                if window[3] in seen:
                    return bits - np.log2(seen[window[3]] / total)
                bits -= np.log2(len(seen) / total)
        return bits + 8

    texts = [row.text[:200] for row in rows[80:100]] + ["", "x", "ÀÉ日本語", "\x00\x00", "|%$ q"]
    for text, bits in zip(texts, ppm.code_lengths(trees, texts)):
        data = b"\0\0\0" + text.lower().encode()
        for lang, got in zip(trees.languages, bits):
            assert got == pytest.approx(sum(cost(lang, data[i - 3 : i + 1]) for i in range(3, len(data))), abs=0.01)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {row.doc_id: row.lang for row in docs.collect()}
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [row for row in got if row.held_out]
    assert {row.doc_id for row in held} == {key for key in lang if zlib.crc32(str(key).encode()) % 5 == 0}
    assert sum(row.lang_pred == lang[row.doc_id] for row in held) >= 0.98 * len(held)
    assert all(0 <= row.score <= 1 for row in got)


def test_texts_without_letters(spark, table):
    rows = [(1, None, "en", "s"), (2, "12 %$\n", "en", "s"), (3, "", None, None), (4, "the", None, None), (None, "of", "de", "s")]
    df = spark.createDataFrame(rows, DOCS)
    trees = ppm.learn(table)
    got = {row.doc_id: row for row in ppm.identify(clashing(df), trees).collect()}
    assert [got[key].lang_pred for key in (1, 2, 3)] == ["und"] * 3
    assert got[4].lang_pred in ("en", "de") and got[None].held_out
    none = ppm.learn(df.where("false"))
    assert {row.lang_pred for row in ppm.identify(df, none).collect()} == {"und"}


# --- 10 ---


@pytest.mark.parametrize("limit", [7, 8, 16, 40])
def test_code_lengths_are_optimal_under_the_limit(limit):
    rng = np.random.default_rng(limit)
    counts = np.floor(np.exp(rng.uniform(0, 12, size=100))).astype(np.int64)
    counts[rng.integers(0, 100, 20)] = 0
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(int)
    assert used.max() <= limit and (lengths[counts == 0] == 0).all()
    assert sum(2.0**-size for size in used) == 1
    if limit == 40:
        import heapq

        heap, cost = sorted(counts[counts > 0].tolist()), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (counts * lengths).sum() == cost


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    n = np.array([1, 300, 256, 257, 5, 1, 2000])
    ids = np.floor(np.exp(rng.uniform(0, 9, size=n.sum()))).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids))
    data, size, marks = huffman.encode(ids, n, huffman.canonical_codes(lengths), lengths)
    runs = -(-n // huffman.STEP)
    counts = np.full(runs.sum(), huffman.STEP)
    counts[np.cumsum(runs) - 1] = n - huffman.STEP * (runs - 1)
    marks = marks + np.repeat((np.cumsum(size) - size) * 8, runs)
    table = huffman.decoding_table(lengths)
    assert (huffman.decode(data, marks, counts, table) == ids).all()
    # A block can be read from any checkpoint on.
    assert (huffman.decode(data, marks[3:4], counts[3:4], table) == ids[301:][: counts[3]]).all()
    assert huffman.code_lengths(np.array([0, 0, 9])).tolist() == [0, 0, 1]


def test_chunks_equal_the_library():
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        known = huffman.Chunks(file.read())
    assert known.direct
    texts = awkward_texts() + ["THEY'LL 's a1b2 x\x1cy\x85z", "́ b", "ÀÖØÞß÷×ª º µ", "a<|startoftext|>b", "\x7f\x00"]
    ids, n = huffman.tokenise(known, [*texts, None], 1)
    ends = np.cumsum(n)
    for text, start, end in zip([*texts, ""], ends - n, ends):
        assert ids[start:end].tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids + [1], repr(text)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_id_files(spark, table, docs, tmp_path, block, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(huffman, "BLOCK", block)
    path = queries.vocabulary("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        huffman.write_ids(clashing(table), str(tmp_path / "ids"), file.read(), 1)
    tokenizer, start = Tokenizer.from_file(path), 0
    got = {row.id: row for row in huffman.read_ids(spark, str(tmp_path / "ids")).collect()}
    for key, text, *_ in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(got[key].ids, "<u4").tolist() == ids
        assert (got[key].start, got[key].n) == (start, len(ids))
        start += len(ids)


# --- all ---


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tables = merges.load(queries.vocabulary("piece_bpe_32k.model"))
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        huffman.write_ids(empty, str(tmp_path / "ids"), file.read(), 1)
    for found in (
        jaccard.similar_documents(empty), tiles.near_duplicates(vectors), sharding.shard_documents(empty),
        merges.decode(merges.encode(empty, tables), tables), perplexity.judged(empty, labels), chat.format_chats(turns),
        content_sort.mark_duplicates(empty), content_sort.drop_duplicates(empty), cube.mix(empty), cube.mixed_documents(empty),
        ppm.identify(empty, ppm.learn(empty)), huffman.read_ids(spark, str(tmp_path / "ids")),
    ):
        assert found.collect() == []
