"""Expert routing over vectors: gate, top-k, dispatch, load, balance, combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gate(vectors: DataFrame, experts: int) -> DataFrame:
    """vec_id, expert, score: the sigmoid of the mean of the vector's components dealt to the expert (i mod experts)."""
    part = lambda e: F.filter(F.col("embedding"), lambda x, i: F.pmod(i, F.lit(experts)) == e)
    logits = F.array(*[F.aggregate(part(e), F.lit(0.0), lambda s, x: s + x.cast("double")) for e in range(experts)])
    return vectors.select("vec_id", F.posexplode(logits).alias("expert", "logit")).select("vec_id", "expert", F.round(1 / (1 + F.exp(-F.col("logit"))), 6).alias("score"))


def top_k(scores: DataFrame, bias: DataFrame | None, k: int) -> DataFrame:
    """The k experts of the highest biased score, the lower number first of equals; weights from unbiased scores."""
    biased = scores.withColumn("key", F.col("score")) if bias is None else scores.join(F.broadcast(bias), "expert").withColumn("key", F.round(F.col("score") + F.col("bias"), 9))
    rn = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("key"), "expert"))
    kept = biased.withColumn("place", rn).where(F.col("place") <= k)
    weight = F.col("score") / F.sum("score").over(W.partitionBy("vec_id"))
    return kept.select("vec_id", "place", "expert", F.round(weight, 6).alias("weight"))


def load(routed: DataFrame, experts: int) -> DataFrame:
    every = routed.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert"))
    counts = routed.groupBy("expert").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "expert", "left").select("expert", F.coalesce("n", F.lit(0)).alias("n"))


def balance(loads: DataFrame, experts: int, rate: float = 0.001) -> DataFrame:
    """expert, bias step: rate * sign(1 / experts - share of the load)."""
    share = F.col("n") / F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1))
    return loads.select("expert", (F.lit(rate) * F.signum(F.lit(1.0 / experts) - share)).alias("step"))


def combine(routed: DataFrame, values: DataFrame) -> DataFrame:
    """vec_id, total: the weighted sum of expert values (expert, value) back at the row they came from."""
    return routed.join(F.broadcast(values), "expert").groupBy("vec_id").agg(F.round(F.sum(F.col("weight") * F.col("value")), 7).alias("total"))


def window_pairs(n: int, width: int, spark) -> DataFrame:
    """(q, k) with k <= q and q - k < width, without a theta join."""
    q = spark.range(n).withColumnRenamed("id", "q")
    return q.select("q", F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - width + 1), F.col("q"))).alias("k"))
