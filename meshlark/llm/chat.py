"""Chat formatting: one marked-up string per conversation, with a loss mask, reversible, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
NEWLINE = "<|n|>"


def escape(text: Column) -> Column:
    """Double the bar of every ``<|``: no control string is left in the text."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, formatted, loss_spans), one row per conversation.

    A conversation's turns are collected as structs and sorted by (turn, role, text). Adjacent turns of one
    role share a block, their texts parted by ``<|im_sep|>``, so each turn can be read back. ``loss_spans``
    are (start, chars) in code points of ``formatted``: one for each text of ``loss_role``, without marks.

    Null text and null role count as empty, a null turn sorts first, a null conv_id is a conversation of its
    own, repeated rows are repeated turns, other columns are dropped, an empty table gives no rows. The string
    of one conversation is one value, so a conversation is limited by Spark's 2 GB for a value.
    """
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ))).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (
        F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = collected.select("conv_id", "turns", starts.alias("starts"))

    def block(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(
            F.get("turns", start)["role"].alias("role"),
            F.transform(F.slice("turns", start + 1, after - start), lambda t: escape(t["text"])).alias("texts"),
        )

    blocks = cut.select("conv_id", F.transform("starts", block).alias("blocks"))
    pieces = blocks.select(
        "conv_id", F.array_join(F.transform("blocks", lambda b: F.concat(
            F.lit(START), _escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(f"{END}\n"))), "").alias("formatted"),
        F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda text, k: F.struct(
            F.when(k == 0, F.length(_escape_role(b["role"])) + len(START) + 1).otherwise(len(SEP)).cast("long").alias("before"),
            F.length(text).cast("long").alias("chars"),
            F.when(k == F.size(b["texts"]) - 1, len(END) + 1).otherwise(0).cast("long").alias("after"),
            (b["role"] == loss_role).alias("loss"),
        )))).alias("laid"),
    )
    no_spans = F.array().cast("array<struct<start:bigint,chars:bigint>>")
    spans = F.aggregate(
        "laid", F.struct(F.lit(0).cast("long").alias("at"), no_spans.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["before"] + x["chars"] + x["after"]).alias("at"),
            F.when(x["loss"], F.array_append(acc["spans"], F.struct(
                (acc["at"] + x["before"]).alias("start"), x["chars"].alias("chars")))).otherwise(acc["spans"]).alias("spans"),
        ), lambda acc: acc["spans"])
    return pieces.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) back to (conv_id, turns of (role, text), n_blocks, loss_text)."""
    blocks = formatted.select("conv_id", "formatted", "loss_spans", F.filter(
        F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "").alias("blocks"))

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        texts = F.split(F.substr(block, F.length(role) + 2), r"<\|im_sep\|>", -1)
        name = _unescape_role(F.substr(role, F.lit(len(START) + 1)))
        return F.transform(texts, lambda text: F.struct(name.alias("role"), unescape(text).alias("text")))

    return blocks.select(
        "conv_id", F.flatten(F.transform("blocks", turns_of)).alias("turns"), F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
            F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "").alias("loss_text"),
        "formatted",
    )


def digest(read: DataFrame) -> DataFrame:
    """The figures that identify what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )
