"""Checks of packed shards: totals, boundaries, ranges, samples, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import packing, vocabulary


def block_facts(packed: DataFrame) -> DataFrame:
    """shard, split, block, n_tokens, n_bos, max_id: the numbers that audits read instead of tokens."""
    s = F.col("stream")
    return packing.with_shards(packed).select("shard", "split", "block", "n_tokens", packing.n_bos(s).alias("n_bos"), packing.max_token(s).cast("long").alias("max_id"))


def by_shard(facts: DataFrame) -> DataFrame:
    return facts.groupBy("shard").agg(F.max("split").alias("split"), F.count(F.lit(1)).alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bos").alias("n_bos"), F.max("max_id").alias("max_id"))


def evenly_spaced(n: Column, k: int) -> Column:
    """Indices of k of n items, ends included; all where n <= k, the first where k = 1."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("long"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(spaced)


def sampled(shards: DataFrame, k: int) -> DataFrame:
    """The rows of k evenly spaced shards (shard numbers are dense)."""
    picks = shards.agg((F.max("shard") + 1).alias("n")).select(F.explode(evenly_spaced(F.col("n"), k)).alias("shard")).distinct()
    return shards.join(picks, "shard", "left_semi")


def bad_shards(shards: DataFrame, block: int) -> DataFrame:
    return shards.where((F.col("n_tokens") == 0) | (F.col("n_tokens") % block != 0))


def resume_gate(shards: DataFrame, state: DataFrame, target: int) -> DataFrame:
    """found, next_shard, consistent, remaining: shards that are there against the state's next one, and those to make."""
    found = shards.agg(F.count_distinct("shard").alias("found"))
    both = found.crossJoin(state.select("next_shard"))  # one row each
    return both.select("found", "next_shard", (F.col("found") == F.col("next_shard")).alias("consistent"), F.greatest(F.lit(target) - F.col("found"), F.lit(0)).cast("long").alias("remaining"))


def mismatches(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, value) tables -> key, actual, expected of the keys that differ."""
    both = actual.select("key", F.col("value").alias("actual")).join(expected.select("key", F.col("value").alias("expected")), "key", "full")
    return both.where(~F.col("actual").eqNullSafe(F.col("expected")))


def dense_ids(vocab: DataFrame) -> DataFrame:
    """One row: whether ids are exactly 0..n-1. Ids are dealt to so many tasks that none holds more than a range of them."""
    ids = vocab.select("id")
    return ids.repartition(vocabulary.ranges(ids), "id").agg(F.count("id").alias("n_ids"), F.count_distinct("id").alias("n_distinct"), F.max("id").cast("long").alias("max_id")).withColumn("dense", (F.col("n_ids") == F.col("n_distinct")) & (F.col("n_ids") == F.col("max_id") + 1))
