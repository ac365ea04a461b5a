"""Conversation turns: a user row with the assistant row that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_answer, clip


def pair_turns(turns: DataFrame, cut: int | None = None) -> DataFrame:
    """User turns in order with the cleaned reply and per-conversation open counts.

    Order matters only next to each other, so the window is keyed by
    (conversation, block of 1024 turns) plus the first row of the next block: a
    conversation holding a third of all rows is spread over many tasks.
    """
    block = F.floor(F.col("turn") / 1024)
    spoken = turns.where("role <> 'system'").withColumn("_b", block)
    heads = spoken.groupBy("conv_id", "_b").agg(F.min_by(F.struct("turn", "role", "text"), "turn").alias("_h"))
    # first row of the following non-empty block, found over one row per block
    nxt = F.lead("_h").over(W.partitionBy("conv_id").orderBy("_b"))
    heads = heads.select("conv_id", "_b", nxt.alias("_next_head"))
    w = W.partitionBy("conv_id", "_b").orderBy("turn")
    paired = spoken.withColumn("_n", F.lead(F.struct("turn", "role", "text")).over(w)).join(heads, ["conv_id", "_b"])
    follow = F.coalesce(F.col("_n"), F.col("_next_head"))
    answered = F.coalesce(follow["role"] == "assistant", F.lit(False))
    users = paired.where("role = 'user'").select(
        "conv_id", "turn", clip(F.col("text"), cut).alias("prompt"),
        clip(clean_answer(F.when(answered, follow["text"])), cut).alias("answer"),
        F.when(answered, "answered").otherwise("open").alias("status"))
    open_turns = users.groupBy("conv_id").agg(F.count_if(F.col("status") == "open").alias("open_turns"))
    return users.join(open_turns, "conv_id")
