"""Conversations: building them from questions and replies, rendering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.arrays import int_div
from tallymark.functions.text import CONTEXT_MESSAGE, TURN_START, chat_turn

BLOCK_TURNS = 256


def render_chat_parts(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      content: str = "text") -> DataFrame:
    """``(conv, part, text)``: rendered blocks of consecutive turns.

    Turn numbers are unique in a conversation, so a block is bounded however
    long the conversation is. The parts in order are the rendered text.
    """
    turns = df.select(conv, int_div(turn, BLOCK_TURNS).alias("part"),
                      F.struct(F.col(turn).alias("t"), chat_turn(role, content).alias("s")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "")
    return turns.groupBy(conv, "part").agg(joined.alias("text"))


def render_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                content: str = "text") -> DataFrame:
    """``(conv, prompt)``: the whole conversation, open for the next reply."""
    parts = render_chat_parts(df, conv, turn, role, content)
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), "")
    return parts.groupBy(conv).agg(F.concat(text, F.lit(f"{TURN_START}model\n")).alias("prompt"))


def build_conversation(samples: DataFrame, replies: DataFrame, key: str, story: str = "story",
                       questions: str = "questions", turns: int = 5) -> DataFrame:
    """``(key, turn, role, content)`` from stories, questions and replies.

    ``replies`` holds ``(key, question_no, reply)`` with question numbers from
    0. A question without a reply gets an empty one.
    """
    opening = samples.select(key, F.lit(0).alias("turn"), F.lit("system").alias("role"),
                             F.concat(F.lit(CONTEXT_MESSAGE), F.coalesce(story, F.lit(""))).alias("content"))
    asked = samples.select(key, F.posexplode(F.slice(questions, 1, turns)).alias("question_no", "question"))
    answered = asked.join(replies, [key, "question_no"], "left")
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.coalesce("reply", F.lit("")).alias("content")))
    lines = answered.select(key, "question_no", F.posexplode(both).alias("__line", "__m"))
    dialogue = lines.select(key, (F.col("question_no") * 2 + F.col("__line") + 1).alias("turn"), "__m.role", "__m.content")
    return opening.unionByName(dialogue)


def first_per_group(df: DataFrame, group: str, order: str, n: int, name: str = "no") -> DataFrame:
    """The first ``n`` rows of every group with their number from 0.

    Spark limits the groups before it shuffles, so a hot one costs ``n`` rows
    per task.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn(name, rank).where(F.col(name) <= n).withColumn(name, F.col(name) - 1)


def conversation_blocks(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(conv, messages)``: one array of role and content for each conversation, in turn order.

    Turns are gathered in blocks first, so a long conversation is put together
    from sorted blocks.
    """
    message: Column = F.struct(F.col(turn).alias("t"), F.struct("role", "content").alias("m"))
    block = df.groupBy(conv, int_div(turn, BLOCK_TURNS).alias("__block")).agg(
        F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("__part"))
    ordered = F.array_sort(F.collect_list(F.struct("__block", "__part")))
    return block.groupBy(conv).agg(F.flatten(F.transform(ordered, lambda b: b["__part"])).alias("messages"))


def conversation_json(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(conv, messages)``: the conversations as JSON text."""
    return conversation_blocks(df, conv, turn).withColumn("messages", F.to_json("messages"))
