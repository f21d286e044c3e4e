"""Chat-style message arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def chat_messages(rows: DataFrame, system: Column, user: Column, transcription: Column) -> DataFrame:
    """Add `messages`: a system turn, a user turn with an audio slot, and the transcription as answer.

    The audio slot holds no data: it marks where the clip of the row's id belongs.
    """

    def part(kind: str, text: Column | None) -> Column:
        body = F.lit(None).cast("string") if text is None else text.cast("string")
        return F.struct(F.lit(kind).alias("type"), body.alias("text"))

    def turn(role: str, *parts: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    messages = F.array(
        turn("system", part("text", system)),
        turn("user", part("audio", None), part("text", user)),
        turn("assistant", part("text", transcription)),
    )
    return rows.withColumn("messages", messages.cast(MESSAGES))


def conversations(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """`conv, messages`: the turns of each conversation in order, as text parts.

    Turns of equal number follow by role and text. One row holds one conversation.
    """
    part = F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text")))
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), part.alias("content"))
    listed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(row)).alias("_t"))
    messages = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return listed.select(conv, messages.cast(MESSAGES).alias("messages"))
