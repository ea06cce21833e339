"""Instruction tuning: pairs from conversations, template, filters, masks, padding, batches, masked loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import stats


def pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, instruction, response: each user turn with the assistant turn right after it."""
    by = W.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumn("next_role", F.lead("role").over(by)).withColumn("response", F.lead("text").over(by))
    return nxt.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("instruction"), "response")


def usable(df: DataFrame) -> DataFrame:
    """Rows whose instruction and response are neither null nor empty."""
    return df.where((F.coalesce("instruction", F.lit("")) != "") & (F.coalesce("response", F.lit("")) != ""))


def examples(df: DataFrame, longest: int = 2048) -> DataFrame:
    """Adds rendered text, its number of byte tokens and mask_len (tokens before the response), no longer than allowed."""
    whole = text.prompt(F.col("instruction"), F.col("response"))
    head = text.prompt(F.col("instruction"), F.lit(""))
    return df.withColumn("rendered", whole).withColumn("n_tokens", F.octet_length("rendered").cast("long")).withColumn("mask_len", F.octet_length(head).cast("long")).where(F.col("n_tokens") <= longest)


def mask_counts(n: Column, mask_len: Column, block: int) -> tuple[Column, Column]:
    """(tokens that count, first that counts) of the x of an example cut to block."""
    length = F.greatest(F.least(n, F.lit(block)) - 1, F.lit(0))
    start = F.greatest(F.lit(0), F.least(length, mask_len - 1))
    return length - start, start


def batches(df: DataFrame, size: int, seed: str) -> DataFrame:
    """Adds batch, place and width (the longest of the batch) in hash order."""
    ranked = stats.hash_rank(df, F.concat_ws("-", "conv_id", "turn"), seed, "conv_id", "turn", out="rn")
    placed = ranked.withColumn("batch", F.floor(F.col("rn") / size)).withColumn("place", F.pmod("rn", F.lit(size)).cast("int")).drop("rn")
    return placed.withColumn("width", F.max("n_tokens").over(W.partitionBy("batch")))


def masked_mean(loss: Column, mask: Column) -> Column:
    return F.sum(loss * mask) / F.greatest(F.sum(mask), F.lit(1))
