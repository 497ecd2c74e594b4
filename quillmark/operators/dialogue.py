"""Conversations: logs, turn pairs, session texts and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import tokens
from quillmark.operators.scale import joined_text, number_rows

TURNS_PER_BUCKET = 4096


def conversation_log(turns: DataFrame, capitalise: bool = True) -> DataFrame:
    """(conv_id, turn, role, content) in order; a null text is empty, a null role is skipped."""
    role = F.initcap("role") if capitalise else F.col("role")
    content = F.coalesce("text", F.lit("")) if capitalise else F.col("text")
    return (
        turns.where(F.col("role").isNotNull())
        .select("conv_id", "turn", role.alias("role"), content.alias("content"))
        .orderBy("conv_id", "turn")
    )


def numbered_turns(turns: DataFrame, out: str = "iteration") -> DataFrame:
    """Number the turns of each conversation from 1; a long conversation is ranked in pieces."""
    bucket = F.floor(F.col("turn") / TURNS_PER_BUCKET)
    return number_rows(turns, ["conv_id"], [F.col("turn")], bucket, out)


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): each user turn with the assistant turn that follows.

    A user turn waits at its own number, an assistant turn at the number before its own, so one
    grouping by (conversation, number) meets each pair. A row moves once, and no conversation is
    held whole.
    """
    is_user = F.col("role") == "user"
    at = F.when(is_user, F.col("rn")).when(F.col("role") == "assistant", F.col("rn") - 1)
    placed = numbered_turns(turns, "rn").select("conv_id", at.alias("at"), "turn", "role", "text")
    met = placed.where(F.col("at").isNotNull()).groupBy("conv_id", "at").agg(
        F.max(F.when(is_user, F.struct("turn", "text"))).alias("a"),
        F.max(F.when(~is_user, F.struct("turn", "text"))).alias("b"),
    )
    return met.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        "conv_id", F.col("a.turn").alias("turn"), F.col("a.text").alias("prompt"),
        F.col("b.text").alias("response"),
    )


def session_text(turns: DataFrame) -> DataFrame:
    """All replies of a conversation, each after a blank line, as one text."""
    replies = turns.where(F.col("role") == "assistant")
    value = F.concat(F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return joined_text(replies, ["conv_id"], "turn", value, "")


def conversation_titles(turns: DataFrame) -> DataFrame:
    """Title from the first user turn of each conversation."""
    return (
        turns.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("prompt"))
        .select("conv_id", tokens.chat_title(F.col("prompt")).alias("title"))
    )
