"""Training batches in closed form: where each rank reads in each step, without iterating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shard_steps(shards: DataFrame, group: int) -> DataFrame:
    """shard, n_tokens -> adds steps ((n - 1) div group) and the number of steps before the shard."""
    steps = F.greatest(F.floor((F.col("n_tokens") - 1) / group), F.lit(0)).cast("long")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return shards.select("shard", "n_tokens", steps.alias("steps")).withColumn("before", F.coalesce(F.sum("steps").over(before), F.lit(0)))


def seek(steps: DataFrame, wanted: DataFrame, accumulation: int) -> DataFrame:
    """wanted (step) -> step, shard, microstep: cyclic over all shards; empty ones never match."""
    total = steps.agg(F.sum("steps").alias("total"))
    at = wanted.crossJoin(F.broadcast(total)).select("step", F.pmod(F.col("step") * accumulation, F.col("total")).alias("k"))  # total is one row
    return at.join(steps, (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("steps"))).select("step", "shard", (F.col("k") - F.col("before")).alias("microstep"))


def position(microstep: Column, rank: Column, batch: int, length: int, world: int) -> Column:
    return microstep * (batch * length * world) + rank * (batch * length)


def rank_windows(steps: DataFrame, batch: int, length: int, world: int) -> DataFrame:
    """shard, microstep, rank, start, stop (one token more than x, for the labels)."""
    each = steps.where("steps > 0").withColumn("microstep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1))).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))
    start = position(F.col("microstep"), F.col("rank"), batch, length, world)
    return each.select("shard", "microstep", "rank", start.alias("start"), (start + batch * length + 1).alias("stop"))
