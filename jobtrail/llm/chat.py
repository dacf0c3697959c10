"""Chat formatting with Spark expressions only (operator 6).

The turns of a conversation are collected as structs, sorted, and adjacent turns of the same role are
merged under one header by array aggregation. The template is

    <role:user>text<also>text</turn>\\n

where ``<also>`` parts the turns that were merged. In roles and texts a backslash becomes two,
``<`` becomes ``\\l`` and ``>`` becomes ``\\g``. An escaped string holds no ``<`` or ``>``, so it can't end a
turn or forge a header: reading back is splitting at the marks and taking the escapes away.

Turns are ordered by (turn, role, text), nulls first; rows that are repeated stay repeated. A null role
or text counts as empty. Rows with a null
conversation id form one conversation with that id. Extra columns are not looked at. An empty table gives no conversation.
A conversation is one string, so it must fit in memory; how many there are does not matter, and the work on one grows with its
length, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import quoted

HEADER = "<role:"
ALSO = "<also>"
END = "</turn>\n"
#: Between a mark and what stands beside it: escaped strings have neither sign.
MARKS = r"(?<=>)|(?=<)"
#: In the order they are applied; the second to last are taken away between escaped backslashes.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"))
#: The role whose texts the loss mask covers.
TAUGHT = "assistant"


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    # Splitting at escaped backslashes first keeps a backslash before an l apart from an escaped <.
    pieces = F.split(text, r"\\\\", -1)

    def plain(piece: Column) -> Column:
        for char, safe in ESCAPES[1:]:
            piece = F.replace(piece, F.lit(safe), F.lit(char))
        return piece

    return F.array_join(F.transform(pieces, plain), "\\")


def format_chats(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conversation, formatted, loss): the string, and the spans of its taught texts.

    ``loss`` is an array of (start, length) in code points, in order, each the escaped text of one
    turn of the ``assistant`` role.
    """
    empty = F.lit("")
    rows = turns.select(
        quoted(conversation).alias("conv"),
        F.struct(
            quoted(turn).alias("turn"),
            F.coalesce(quoted(role), empty).alias("role"),
            F.coalesce(quoted(text), empty).alias("text"),
        ).alias("said"),
    )
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("said"))

    # Where a role differs from the one before it, a merged turn starts.
    said = F.col("said")
    parts = F.transform(
        said,
        lambda x, i: F.struct(
            F.when((i > 0) & (F.get(said, i - 1)["role"] == x["role"]), F.lit(ALSO))
            .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(empty), F.lit(HEADER), escaped(x["role"]), F.lit(">")))
            .alias("mark"),
            escaped(x["text"]).alias("text"),
            (x["role"] == TAUGHT).alias("taught"),
        ),
    )
    # One row per part, so that places are running sums: appending to an array copies it each time. The rows of a
    # conversation stay together, so nothing is shuffled again.
    rows = chats.select("conv", F.posexplode(parts).alias("nth", "part")).select("conv", "nth", "part.*")
    before = Window.partitionBy("conv").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("mark") + F.length("text")).over(before), F.lit(0)) + F.length("mark")
    rows = rows.select(
        "conv",
        F.struct(
            "nth", F.concat("mark", "text").alias("part"), "taught",
            F.struct(at.cast("int").alias("start"), F.length("text").alias("length")).alias("span"),
        ).alias("piece"),
    )
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda x: x["part"]), ""), F.lit(END))
    spans = F.transform(F.filter("pieces", lambda x: x["taught"]), lambda x: x["span"])
    return chats.select(
        F.col("conv").alias(conversation), formatted.alias("formatted"), spans.alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns a formatted string holds: an array of (role, text)."""
    blocks = F.split(formatted, END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        texts = F.split(block, ALSO, -1)
        role = F.substring(F.substring_index(texts[0], ">", 1), len(HEADER) + 1, 2**31 - 1)
        return F.transform(
            texts,
            lambda text: F.struct(
                unescaped(role).alias("role"), unescaped(F.substring_index(text, ">", -1)).alias("text")
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(chats: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, taught): the text under the loss mask, unescaped, of each row of ``format_chats``.

    The string is cut at its marks, once; running sums give each piece its place, where spans find it.
    """
    conv = quoted(conversation)
    pieces = chats.select(conv.alias("conv"), F.posexplode(F.split("formatted", MARKS, -1)).alias("nth", "piece"))
    before = Window.partitionBy("conv").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    spans = chats.select(conv.alias("of"), F.inline("loss")).where("length > 0")
    under = F.col("conv").eqNullSafe(F.col("of")) & (pieces["start"] == spans["start"])
    found = pieces.join(spans, under, "left").select(
        "conv",
        F.when(
            F.col("length").isNotNull(),
            F.struct(pieces["start"], unescaped(F.substring("piece", F.lit(1), F.col("length"))).alias("text")),
        ).alias("said"),
    )
    found = found.groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("said"))
    text = F.array_join(F.transform("said", lambda x: x["text"]), "")
    return found.select(F.col("conv").alias(conversation), text.alias("taught"))
