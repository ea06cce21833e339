"""Multiple-choice evaluation: rendering, length-normalised scoring, accuracy, macro mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render(items: DataFrame) -> DataFrame:
    """item, context, choices -> item, choice, context, ending (a space before it), n_context, n_ending in bytes."""
    each = items.select("item", "context", F.posexplode("choices").alias("choice", "c"))
    ending = F.concat(F.lit(" "), F.col("c"))
    return each.select("item", "choice", "context", ending.alias("ending"), F.octet_length("context").cast("long").alias("n_context"), F.octet_length(ending).cast("long").alias("n_ending"))


def best(scored: DataFrame) -> DataFrame:
    """item, choice, loss -> item, predicted: the least loss, the first choice of equal ones."""
    return scored.groupBy("item").agg(F.min_by("choice", F.struct("loss", "choice")).alias("predicted"))


def accuracy(judged: DataFrame) -> DataFrame:
    """task, correct (null where scoring failed) -> task, n, accuracy; null where a task has none."""
    n = F.count("correct")
    return judged.groupBy("task").agg(n.alias("n"), F.when(n > 0, F.round(F.sum(F.col("correct").cast("int")) / n, 6)).alias("accuracy"))


def repaired(raw: DataFrame) -> DataFrame:
    """Items with alternative field names: question or its stem; rows whose key isn't among the labels go."""
    stem = F.coalesce("question", "question_stem")
    ok = raw.where(F.array_contains("labels", F.col("answer_key")))
    return ok.select("item", stem.alias("context"), "choices", (F.array_position("labels", F.col("answer_key")) - 1).cast("int").alias("label"))


def byte_losses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """byte, loss: add-one smoothed unigram loss in nats, a scorer that any engine reproduces."""
    from corpusforge.operators.stats import token_histogram

    counts = token_histogram(docs, text_col).where("token_id < 256")
    every = counts.sparkSession.range(256).select(F.col("id").cast("int").alias("byte"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    full = every.join(counts, every["byte"] == counts["token_id"], "left").crossJoin(F.broadcast(total))
    return full.select("byte", (-F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + 256))).alias("loss"))


def score(rendered: DataFrame, losses: DataFrame) -> DataFrame:
    """item, choice, loss: mean byte loss of the ending."""
    pair = F.explode(F.regexp_extract_all(F.hex(F.encode("ending", "UTF-8")), F.lit(".."), F.lit(0)))
    each = rendered.select("item", "choice", pair.alias("p")).select("item", "choice", F.conv("p", 16, 10).cast("int").alias("byte"))
    return each.join(F.broadcast(losses), "byte").groupBy("item", "choice").agg(F.round(F.avg("loss"), 9).alias("loss"))  # 256 rows
