"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted by turn; adjacent
turns of one role are merged, as slices of the array that are joined to one
string each; and the blocks are concatenated to one text, all in time with the
conversation's length::

    <|turn:role|>first turn<|+|>second turn of the same role<|end|>\\n

Inside roles and texts a backslash becomes ``\\e``, ``<`` becomes ``\\l`` and
``|`` becomes ``\\p``, so no text can hold a mark, and reading back by the
marks restores every turn.  Loss falls on the texts of one role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and what is escaped as what (in the order of escaping).
OPEN, SHUT, MORE, END = "<|turn:", "|>", "<|+|>", "<|end|>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("|", "\\p"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: ``key`` and ``formatted``.

    Rows are put in order of turn (nulls first), then role, then text, so ties
    have one order; repeated rows stay repeated.  Null roles and texts are
    empty; a null key is a conversation of its own; other columns are ignored;
    an empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]
    # A block starts where the role is not that of the turn before, and is the slice up to the next start.
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    stops = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns")))
    blocks = turns.select(key, "turns", starts.alias("starts"))
    blocks = blocks.select(key, "turns", F.arrays_zip(F.col("starts").alias("start"), stops.alias("stop")).alias("blocks"))

    def block(b: Column) -> Column:
        texts = F.transform(F.slice("turns", b["start"] + 1, b["stop"] - b["start"]), lambda t: escape(t["text"]))
        return F.concat(F.lit(OPEN), escape(role(b["start"])), F.lit(SHUT), F.array_join(texts, MORE), F.lit(END))

    return blocks.select(key, F.array_join(F.transform("blocks", block), "").alias("formatted"))


def _split(formatted: str | Column) -> Column:
    """The blocks of a formatted text, without their END."""
    # The text ends with END, so the last piece after splitting is empty.
    pieces = F.split(formatted, "\\Q" + END + "\\E", -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_turns(formatted: str | Column = "formatted") -> Column:
    """The turns of a formatted text: array of (role, text), by its marks alone."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), SHUT, 1)
        body = F.substr(block, F.length(role) + F.lit(len(OPEN) + len(SHUT) + 1))
        return F.transform(
            F.split(body, "\\Q" + MORE + "\\E", -1),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(_split(formatted), turns))


def loss_mask(formatted: str | Column = "formatted", role: str = "assistant") -> Column:
    """The loss mask by blocks: array of (block, start), for each block of ``role`` its text and where the loss begins in it.

    Loss falls on all that follows the block's head but the marks between
    merged turns; positions count from the block, so cutting takes time in
    proportion to the text.
    """
    head = F.concat(F.lit(OPEN), escape(F.lit(role)), F.lit(SHUT))
    own = F.filter(_split(F.col(formatted) if isinstance(formatted, str) else formatted), lambda b: F.startswith(b, head))
    return F.transform(own, lambda b: F.struct(b.alias("block"), F.length(head).alias("start")))


def loss_text(mask: str | Column) -> Column:
    """All text under a loss mask, unescaped, in order, nothing between."""
    under = F.transform(mask, lambda m: F.replace(F.substr(m["block"], m["start"] + 1), F.lit(MORE), F.lit("")))
    return unescape(F.array_join(under, ""))


def loss_spans(formatted: str | Column = "formatted", role: str = "assistant") -> Column:
    """The loss mask over the formatted text: array of (start, stop) in code points, one for each turn of ``role``."""
    turns = read_turns(formatted)
    begin = F.struct(
        F.array().cast("array<struct<start: int, stop: int>>").alias("spans"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("role")
    )

    def step(state: Column, turn: Column) -> Column:
        same = state["role"].isNotNull() & (state["role"] == turn["role"])
        head = F.length(escape(turn["role"])) + F.lit(len(OPEN) + len(SHUT))
        gap = F.when(same, F.lit(len(MORE))).when(state["role"].isNull(), head).otherwise(head + F.lit(len(END)))
        start = state["at"] + gap
        stop = start + F.length(escape(turn["text"]))
        span = F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))
        return F.struct(
            F.when(turn["role"] == role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
            stop.cast("int").alias("at"),
            turn["role"].alias("role"),
        )

    return F.aggregate(turns, begin, step, lambda s: s["spans"])


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What is read back from the formatted texts: counts and digests per conversation."""
    read = formatted.select(key, "formatted", read_turns().alias("turns"), loss_text(loss_mask()).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
