"""Chat formatting with Spark expressions only (operator 6).

Turns of a conversation are collected and sorted, neighbours of one role are merged into one block by
array functions, and blocks are concatenated:

    <|role ROLE|><|text|>TEXT<|text|>TEXT ... </turn>

Texts and roles are escaped so that the template's control strings, which all begin with ``<``, and
headings of other templates, which begin with ``#``, cannot stand inside them; the escape is undone
exactly by ``unescape``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings, and the escapes in the order in which they are made (and undone backwards).
ROLE, ROLE_END, TEXT, END = "<|role ", "|>", "<|text|>", "</turn>\n"
ESCAPES = (("%", "%25"), ("<", "%3C"), ("#", "%23"), ("|", "%7C"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, and ``segments`` (text, loss) that make it up, loss marking the texts of ``trained``.

    Turns are ordered by turn, then role, then text (nulls first); null roles and texts are empty.
    Rows of a null conversation form one conversation. Equal rows are turns of their own. Other
    columns are ignored.
    """
    collected = df.groupBy(F.col(conversation).alias(conversation)).agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns"))
    # the first turn of every block of one role, and one place past the last turn
    begins = F.concat(F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns.role", i) != F.get("turns.role", i - 1))), F.array(F.size("turns")))
    collected = collected.select(conversation, F.inline(F.array(F.struct(F.col("turns"), begins.alias("begins")))))
    blocks = F.transform(F.slice("begins", F.lit(1), F.size("begins") - 1), lambda b, i: F.struct(
        F.get("turns.role", b).alias("role"), F.slice("turns.text", b + 1, F.get("begins", i + 1) - b).alias("texts")))
    collected = collected.select(conversation, F.inline(F.array(F.struct(blocks.alias("blocks")))))

    def segment(value, loss):
        return F.struct(value.alias("text"), loss.alias("loss"))

    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(segment(F.concat(F.lit(ROLE), escape(b["role"]), F.lit(ROLE_END)), F.lit(False))),
        F.flatten(F.transform(b["texts"], lambda t: F.array(segment(F.lit(TEXT), F.lit(False)), segment(escape(t), b["role"] == trained)))),
        F.array(segment(F.lit(END), F.lit(False))))))
    collected = collected.select(conversation, F.inline(F.array(F.struct(pieces.alias("segments")))))
    return collected.select(conversation, F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turns(block):
        parts = F.split(block, r"<\|text\|>")
        role = unescape(F.replace(F.substring(F.get(parts, F.lit(0)), len(ROLE) + 1, 1 << 30), F.lit(ROLE_END), F.lit("")))
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def chat_digest(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Counts and digests of formatted conversations, read back from them."""
    back = formatted.select(conversation, F.inline(F.array(F.struct(
        F.col("formatted"), read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss")))))
    return back.select(
        conversation, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
