"""Accounting of training runs: parameters, FLOPs, throughput, best losses, retention, launch checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.functions.numeric import up_to


def _sizes(c=F.col) -> dict[str, Column]:
    d = c("n_embd")
    head = F.floor(d / c("n_heads"))
    attention = 2 * d * c("n_heads") * head + 2 * d * c("n_kv_heads") * head + 2 * head
    dense = 3 * d * up_to(c("ffn"), 256)
    expert = 3 * d * c("expert_hidden")
    fixed = 3 * d * up_to(c("n_shared") * c("expert_hidden"), 256) + d * c("n_routed")
    moe = c("ffn").isNull()
    all_ffn = F.when(moe, fixed + c("n_routed") * expert).otherwise(dense)
    active_ffn = F.when(moe, fixed + c("topk") * expert).otherwise(dense)
    return {"head": head, "total": attention + all_ffn + 2 * d, "active": attention + active_ffn + 2 * d}


def parameters(configs: DataFrame) -> DataFrame:
    """name, total_params, active_params."""
    s, c = _sizes(), F.col
    ends = c("vocab") * c("n_embd") * F.when(c("tied"), 1).otherwise(2) + c("n_embd")
    return configs.select("name", (ends + c("n_layers") * s["total"]).cast("long").alias("total_params"), (ends + c("n_layers") * s["active"]).cast("long").alias("active_params"))


def flops(configs: DataFrame) -> DataFrame:
    """name, flops_per_token: six for each active parameter of the layers, and attention over the block."""
    s, c = _sizes(), F.col
    return configs.select("name", (6 * c("n_layers") * s["active"] + 12 * c("n_layers") * c("n_heads") * s["head"] * c("block")).cast("long").alias("flops_per_token"))


def best_so_far(log: DataFrame, start: float = 100.0) -> DataFrame:
    """step, loss -> adds best (before the step) and is_best (strictly less)."""
    before = F.least(F.lit(start), F.coalesce(F.min("loss").over(W.partitionBy("run").orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(start)))
    return log.withColumn("best", before).withColumn("is_best", F.col("loss") < before)


def retained(checkpoints: DataFrame, keep_from: int) -> DataFrame:
    """step: what remains: each early checkpoint replaces all before it, from keep_from on all stay."""
    early = F.max(F.when(F.col("step") < keep_from, F.col("step"))).over(W.partitionBy())
    return checkpoints.withColumn("early", early).where((F.col("step") >= keep_from) | (F.col("step") == F.col("early"))).drop("early")


def latest_complete(paths: DataFrame) -> DataFrame:
    """path, complete -> the one path of the highest step that has its commit marker."""
    step = F.regexp_extract("path", r"step_(\d+)/?$", 1)
    found = paths.where(F.col("complete")).select("path", step.try_cast("long").alias("step")).where("step IS NOT NULL")
    return found.agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))


def global_layer(i: Column, n_layers: int, every: int, placement: str) -> Column:
    if every <= 0:
        return F.lit(True)
    return F.pmod(i, F.lit(every)) == every - 1 if placement == "end" else (F.pmod(i, F.lit(every)) == 0) | (i == n_layers - 1)


def rotary(spark, length: int, dim: int, base: float = 10000.0, share: float = 1.0) -> DataFrame:
    """pos, pair, sin, cos; pairs beyond round(share x pairs) don't rotate."""
    half = dim // 2
    turning = max(1, round(share * half)) if share < 1 else half
    angle = F.when(F.col("pair") < turning, F.col("pos") / F.pow(F.lit(base), 2.0 * F.col("pair") / dim)).otherwise(F.lit(0.0))
    grid = spark.range(length).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("pair"))
    return grid.select("pos", "pair", F.sin(angle).alias("sin"), F.cos(angle).alias("cos"))


def preflight(shards: DataFrame, *, group: int, accumulation: int, steps: int, down_ratio: float, parameters: int) -> DataFrame:
    """One row: steps that the training shards hold, tokens wanted, tokens a parameter, start of the warm-down."""
    micro = F.sum(F.when(F.col("split") == "train", F.floor((F.col("n_tokens") - 1) / group)).otherwise(0))
    tokens = steps * accumulation * group
    return shards.agg(
        F.count_if(F.col("split") == "train").alias("train_shards"), F.count_if(F.col("split") == "val").alias("val_shards"), micro.cast("long").alias("microsteps"),
        F.floor(micro / accumulation).alias("steps_available"), (F.floor(micro / accumulation) >= steps).alias("enough"), F.lit(tokens).cast("long").alias("tokens"),
        F.round(F.lit(tokens / parameters), 2).alias("tokens_per_parameter"), F.lit(steps - round(down_ratio * steps)).cast("long").alias("down_from"),
    )
