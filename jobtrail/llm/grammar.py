"""Secret scans by grammar inference (operator 13).

Base patterns name three kinds of credentials. What they find is labelled: of each kind a sample of
distinct credentials, and of each of three kinds of ordinary tokens, those of letters, those without letters and
mixed ones, a sample too. Each sample becomes a prefix tree with
counts, whose states are merged where the strings that go on from them are distributed alike: how often
strings end there and how often each character follows must differ within Hoeffding's bound, there and in the
successors, and all strings together must cost no more bits than strings of that state do. What
remains is a probabilistic automaton, the format of that kind: fixed heads stay chains of states, random
tails fold into loops over their alphabet.

Every token of every text is then a candidate. Under each format it costs so many bits, and so many more for how
rare the kind is among all tokens. If a credential's automaton accepts it, its bits under the cheapest ordinary kind less those
under the cheapest credential say how much likelier than not it is a credential. From ``MARGIN`` on it
is reported with kind ``format``, unless it touches a span of the base patterns; those always stay.

A candidate is a run of letters, digits and ``+/_.-``, without dots at its ends, with up to two ``=`` after it, of
``SHORTEST`` characters at least. Samples are for fitting only and bounded: the ``SAMPLE`` values of a kind
with the smallest hashes, of at most ``LONGEST`` characters each. Numbers of tokens are counted and candidates scored in all documents and whole
texts. Positions are code points, ends exclusive. A null or empty text has no spans. Ids may be null or repeat. Extra columns are not
looked at. An empty table gives no rows; where the base patterns find nothing, nothing is learned and nothing added.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail.llm.common import hex_digest, quoted
from jobtrail.sources.shared import stored

KINDS = ("assign", "access", "hex")
#: Ordinary tokens by what they are made of: only letters, no letters, both.
ORDINARY = ("letters", "numbers", "mixed")
ADDED = "format"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
#: An assignment has one of these in small letters.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
# A run that is too short holds no shorter one that is long enough, so length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_HEX = 24

SHORTEST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{%d,}={0,2}" % SHORTEST)
LETTERS = 67

#: Distinct values that a format is fitted to, and the longest of them.
SAMPLE = 5000
LONGEST = 128
#: Chance of calling two equal distributions different.
ALPHA = 0.05
#: Standard deviations that strings may cost more than those of the state they join.
TYPICAL = 3.0
#: Bits by which a candidate must be likelier a credential than not.
MARGIN = 10.0
#: Tokens whose verdict a task remembers.
REMEMBERED = 300_000

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("bits", T.DoubleType()),
    ]
)
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])


# --- texts ---


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(start, token) of every candidate."""
    for match in CANDIDATE.finditer(text):
        token = match[0].lstrip(".")
        start = match.end() - len(token)
        token = token.rstrip(".")
        if len(token) >= SHORTEST:
            yield start, token


def tokens(text: str) -> set[str]:
    """The candidates of a text, each once."""
    found = {token.strip(".") for token in set(CANDIDATE.findall(text))}
    return {token for token in found if len(token) >= SHORTEST}


def base_spans(text: str, known: set[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of what the base patterns find; ``known`` are the text's candidates."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        spans += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text)]
    if any(len(token) >= LEAST_HEX for token in known):
        spans += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))


def shape(token: str) -> str:
    """The kind of an ordinary token."""
    if token.isalpha():
        return "letters"
    return "mixed" if any(map(str.isalpha, token)) else "numbers"


# --- inference ---


class Tree:
    """A prefix tree of strings with counts, on its way to an automaton: edges are [target, count] by character."""

    def __init__(self, strings: list[str]):
        self.n, self.ends, self.edges = [0], [0], [{}]
        #: By state the number its costs were worked out for, and they.
        self.known: dict[int, tuple[int, tuple]] = {}
        for string in strings:
            at = 0
            self.n[0] += 1
            for char in string:
                edge = self.edges[at].get(char)
                if edge is None:
                    edge = self.edges[at][char] = [len(self.n), 0]
                    self.n.append(0)
                    self.ends.append(0)
                    self.edges.append({})
                edge[1] += 1
                at = edge[0]
                self.n[at] += 1
            self.ends[at] += 1

    def costs(self, state: int) -> tuple[dict, float, float, float]:
        """(bits, unseen, mean, variance): bits of what follows a state, its end under None, and of what has not
        followed yet, which is as likely as something new was among what has."""
        known = self.known.get(state)
        if known and known[0] == self.n[state]:
            return known[1]
        n, seen = self.n[state], {char: count for char, (_, count) in self.edges[state].items()}
        if self.ends[state]:
            seen[None] = self.ends[state]
        total = n + len(seen)
        bits = {char: math.log2(total / count) for char, count in seen.items()}
        fresh = len(seen) / total
        unseen = math.log2((LETTERS + 1) / fresh)
        mean = sum(count / total * bits[char] for char, count in seen.items()) + fresh * unseen
        square = sum(count / total * bits[char] ** 2 for char, count in seen.items()) + fresh * unseen**2
        found = (bits, unseen, mean, square - mean**2)
        self.known[state] = (n, found)
        return found

    def likeness(self, a: int, b: int, bound: float) -> float | None:
        """Bits of the strings from ``b``, the root of a tree, if they went on from ``a``; None if they differ
        too much from those that do."""
        pairs, total, expected, spread = [(a, b)], 0.0, 0.0, 1.0
        while pairs:
            a, b = pairs.pop()
            n = self.n[b]
            bits, unseen, mean, variance = self.costs(a)
            total += self.ends[b] * bits.get(None, unseen)
            expected += n * mean
            spread += n * variance
            room = bound * (self.n[a] ** -0.5 + n**-0.5)
            # So few strings differ from nothing.
            if room < 1:
                parts = [(self.ends[a], self.ends[b])]
                for char in self.edges[a].keys() | self.edges[b].keys():
                    parts.append((self.edges[a].get(char, (0, 0))[1], self.edges[b].get(char, (0, 0))[1]))
                if any(abs(of_a / self.n[a] - of_b / n) > room for of_a, of_b in parts):
                    return None
            for char, (target, count) in self.edges[b].items():
                total += count * bits.get(char, unseen)
                if char in self.edges[a]:
                    pairs.append((self.edges[a][char][0], target))
        return total if total - expected <= TYPICAL * math.sqrt(spread) else None

    def fold(self, a: int, b: int) -> list[tuple[int, str]]:
        """Add the tree from ``b`` to what goes on from ``a``; the edges that are new."""
        pairs, new = [(a, b)], []
        while pairs:
            a, b = pairs.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for char, (target, count) in self.edges[b].items():
                edge = self.edges[a].get(char)
                if edge is None:
                    self.edges[a][char] = [target, count]
                    new.append((a, char))
                else:
                    edge[1] += count
                    pairs.append((edge[0], target))
        return new


def infer(strings: list[str], alpha: float = ALPHA) -> dict:
    """The automaton of ``strings``: bits of ending in each state, and of each character with the next state.

    States at the fringe of the settled ones are taken by the number of strings through them. One that is
    like settled states becomes the one that explains its strings in the fewest bits, another settles.
    """
    tree = Tree(sorted(strings))
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    settled = {0: 0}
    fringe: list[tuple] = []

    def reach(state: int, char: str) -> None:
        heapq.heappush(fringe, (-tree.n[tree.edges[state][char][0]], settled[state], char, state))

    for char in tree.edges[0]:
        reach(0, char)
    while fringe:
        *_, char, at = heapq.heappop(fringe)
        state = tree.edges[at][char][0]
        found = [(tree.likeness(other, state, bound), place, other) for other, place in settled.items()]
        found = [like for like in found if like[0] is not None]
        if found:
            same = min(found)[2]
            tree.edges[at][char][0] = same
            for start, added in tree.fold(same, state):
                if start in settled:
                    reach(start, added)
        else:
            settled[state] = len(settled)
            for added in tree.edges[state]:
                reach(state, added)
    ends, unseen, steps = [], [], []
    for state in settled:
        bits, new, *_ = tree.costs(state)
        ends.append(bits.get(None, new))
        unseen.append(new)
        steps.append({char: [settled[target], bits[char]] for char, (target, _) in sorted(tree.edges[state].items())})
    return {"ends": ends, "unseen": unseen, "steps": steps}


def format_bits(automaton: dict, string: str, strict: bool) -> float | None:
    """Bits of a string under an automaton. A character that it has not seen goes back to the start, or, if
    ``strict``, says that the string does not have the format."""
    steps = automaton["steps"]
    state, total = 0, 0.0
    for char in string:
        step = steps[state].get(char)
        if step is not None:
            state = step[0]
            total += step[1]
        elif strict:
            return None
        else:
            total += automaton["unseen"][state]
            state = 0
    return total + automaton["ends"][state]


def gain(formats: dict, token: str) -> float:
    """Bits by which the likeliest kind of credential beats the likeliest kind of ordinary token; none if it
    has no kind's format. ``formats`` has (automaton, bits of the kind itself) by kind."""

    def least(kinds: tuple, strict: bool) -> float:
        known = (formats[kind] for kind in kinds if kind in formats)
        costs = ((format_bits(automaton, token, strict), rarity) for automaton, rarity in known)
        return min((bits + rarity for bits, rarity in costs if bits is not None), default=math.inf)

    secret = least(KINDS, True)
    if secret == math.inf:
        return -math.inf
    return min(least(ORDINARY, False), len(token) * math.log2(LETTERS)) - secret


# --- jobs ---


def _hash(value: str) -> int:
    return zlib.crc32(value.encode())


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each kind the number of values, and those of a task with the smallest hashes."""
    number: Counter = Counter()
    held: dict[str, dict[str, int]] = {kind: {} for kind in (*KINDS, *ORDINARY)}

    def cut(kind: str, most: int) -> None:
        if len(held[kind]) > most:
            best = sorted(held[kind].items(), key=lambda item: (item[1], item[0]))[:SAMPLE]
            held[kind] = dict(best)

    for batch in batches:
        for value in batch.column(0):
            if not value.is_valid:
                continue
            text = value.as_py()
            known = tokens(text)
            spans = base_spans(text, known)
            labelled = {kind: {span[3] for span in spans if span[2] == kind} for kind in KINDS}
            labelled |= {kind: set() for kind in ORDINARY}
            for token in known:
                # A token that touches a base span is no ordinary one.
                if not any(credential in token or token in text[start:end] for start, end, _, credential in spans):
                    labelled[shape(token)].add(token)
            number.update(span[2] for span in spans)
            number.update({kind: len(labelled[kind]) for kind in ORDINARY})
            for kind, values in labelled.items():
                own = held[kind]
                for token in values:
                    if token not in own and len(token) <= LONGEST:
                        own[token] = _hash(token)
                cut(kind, 8 * SAMPLE)
    kinds, values, hashes, counts = [], [], [], []
    for kind, own in held.items():
        cut(kind, SAMPLE)
        kinds += [kind] * (len(held[kind]) + 1)
        values += [None, *held[kind]]
        hashes += [0, *held[kind].values()]
        counts += [number[kind]] + [0] * len(held[kind])
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(values, pa.string()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64())],
        ["kind", "value", "hash", "n"],
    )


def _inferred(rows: pa.Table) -> pa.Table:
    return pa.table({"kind": rows["kind"][:1], "format": [json.dumps(infer(rows["value"].to_pylist()))]})


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict:
    """(automaton, bits of how rare the kind is among all tokens) of each kind that occurs, credential or ordinary.
    One automaton a kind comes to the driver."""
    found = docs.select(quoted(text).alias("text")).mapInArrow(_labelled, "kind string, value string, hash long, n long")
    found = stored(found, "labelled")
    number = {row.kind: row.n for row in found.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    values = found.where("value IS NOT NULL").groupBy("kind", "value").agg(F.first("hash").alias("hash"))
    # Cut in parts first: no task meets the values of all tasks of one kind.
    for keys in (("kind", F.pmod("hash", F.lit(64))), ("kind",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "value"))
        values = values.withColumn("place", place).where(F.col("place") <= sample).drop("place")
    made = values.groupBy("kind").applyInArrow(_inferred, "kind string, format string").collect()
    total = sum(number.values())
    return {row["kind"]: (json.loads(row["format"]), math.log2(total / number[row["kind"]])) for row in made}


def scan(docs: DataFrame, formats: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): all spans (kind, start, end, bits) of each text in order; base spans have no bits."""
    rows = docs.select(quoted(key).alias("id"), quoted(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        verdicts: dict[str, float] = {}
        for batch in batches:
            found = []
            for value in batch.column(1):
                content = value.as_py() or ""
                known = tokens(content)
                spans = base_spans(content, known)
                hits = set()
                for token in known:
                    bits = verdicts.get(token)
                    if bits is None:
                        if len(verdicts) >= REMEMBERED:
                            verdicts.clear()
                        bits = verdicts[token] = gain(automata, token)
                    if bits >= MARGIN:
                        hits.add(token)
                named = [(start, KINDS.index(kind), end, None) for start, end, kind, _ in spans]
                if hits:
                    for start, token in candidates(content):
                        end = start + len(token)
                        if token in hits and not any(a < end and start < b for a, b, *_ in spans):
                            named.append((start, len(KINDS), end, verdicts[token]))
                found.append(
                    [
                        {"kind": (*KINDS, ADDED)[kind], "start": start, "end": end, "bits": bits}
                        for start, kind, end, bits in sorted(named, key=lambda span: span[:3])
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(ARROW_SPAN))], ["id", "spans"])

    schema = T.StructType([rows.schema["id"], T.StructField("spans", T.ArrayType(SPAN))])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``scan`` under formats learned from the same documents."""
    return scan(docs, learn(docs, text), key, text)


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of what ``scan`` gives."""

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return found.select(
        quoted(key), *map(number, KINDS), hex_digest(spelled(base)).alias("base_sha256"), spelled(F.col("spans")).alias("spans")
    )
