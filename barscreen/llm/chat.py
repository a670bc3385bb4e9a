"""Chat formatting: conversations as training strings with a loss mask, in built-in expressions only.

A message is ``<|im_start|>role``, a newline, its text, ``<|im_end|>`` and a newline. Adjacent turns of one role are one
message, their texts parted by ``<|im_sep|>``. In roles and texts each ``<``, backslashes, ``|`` gets one backslash more,
so nothing in them reads as a mark, and taking one away gives the text back. A newline in a role is written ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, END, SEPARATOR = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
#: Stands for a newline in a role.
NEWLINE = "<|nl|>"
LEARNT_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, learnt: str = LEARNT_ROLE) -> DataFrame:
    """(conv_id, formatted, segments) from ``turns`` (conv_id, turn, role, text).

    Turns are ordered by turn (null first), ties by role and text; repeated rows are turns of their own. A null text
    or role is empty; rows with a null conv_id are one conversation. ``segments`` (text, loss) are the string in
    pieces: those of ``learnt`` texts carry the loss, marks and all else don't. A conversation is one string, so its
    turns meet in one task. An empty table gives an empty table.
    """
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def messages(t: Column) -> Column:
        """(role, texts) for each run of turns of one role."""
        change = F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["role"] != x["role"]), i))
        return let(F.array_compact(change), lambda first: F.transform(first, lambda a, k: F.struct(
            F.get(t, a)["role"].alias("role"),
            F.transform(F.slice(t, a + 1, F.coalesce(F.get(first, k + 1), F.size(t)) - a), lambda x: x["text"]).alias("texts"),
        )))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(m: Column) -> Column:
        role = F.replace(escaped(m["role"]), F.lit("\n"), F.lit(NEWLINE))
        no = F.lit(False)
        body = F.transform(m["texts"], lambda x, i: F.array(
            piece(F.when(i == 0, F.concat(F.lit(START), role, F.lit("\n"))).otherwise(F.lit(SEPARATOR)), no),
            piece(escaped(x), m["role"] == learnt),
        ))
        return F.concat(F.flatten(body), F.array(piece(F.lit(END + "\n"), no)))

    parts = ordered.select("conv_id", F.flatten(F.transform(let(F.col("turns"), messages), segments)).alias("segments"))
    return parts.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, an array."""
    quoted = lambda mark: mark.replace("|", r"\|")
    blocks = F.filter(F.split(formatted, quoted(END + "\n")), lambda b: b != "")
    message = F.transform(blocks, lambda b: F.substr(b, F.lit(len(START) + 1)))

    def turns(m: Column) -> Column:
        at = F.locate("\n", m)
        role = unescaped(F.replace(F.substr(m, F.lit(1), at - 1), F.lit(NEWLINE), F.lit("\n")))
        texts = F.split(F.substr(m, at + 1), quoted(SEPARATOR))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(message, turns))


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations``, as counts and digests."""
    back = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), learnt_text(F.col("segments")).alias("learnt"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
