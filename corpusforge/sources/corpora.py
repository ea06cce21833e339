"""Corpus readers: Parquet, JSON lines, whole-text files, nested multiple-choice items, tokenizer models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = "ind int, activity_label string, ctx_a string, ctx_b string, ctx string, split string, split_type string, label int, endings array<string>, source_id string"
CHOICE_SCHEMA = "question string, question_stem string, choices struct<text: array<string>, label: array<string>>, answerKey string"


def documents(spark: SparkSession, path: str, *, streaming: bool = False, schema=None) -> DataFrame:
    if streaming:
        return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)
    return spark.read.parquet(path)


def four_way_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (ctx, endings, label) -> item, context, choices, label."""
    raw = spark.read.schema(ITEM_SCHEMA).json(path)
    return raw.select(F.col("ind").alias("item"), F.col("ctx").alias("context"), F.col("endings").alias("choices"), "label")


def keyed_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with nested choices and a lettered key; rows whose key is no label go."""
    raw = spark.read.schema(CHOICE_SCHEMA).json(path)
    ok = raw.where(F.array_contains("choices.label", F.col("answerKey")))
    return ok.select(F.coalesce("question", "question_stem").alias("context"), F.col("choices.text").alias("choices"), (F.array_position("choices.label", F.col("answerKey")) - 1).cast("int").alias("label"))


def instructions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with instruction|prompt and response|output; absent fields read as null."""
    raw = spark.read.schema("instruction string, prompt string, response string, output string").json(path)
    return raw.select(F.coalesce("instruction", "prompt").alias("instruction"), F.coalesce("response", "output").alias("response"))


def registry(tasks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """One table of all tasks with their names; a task that can't be read is left out and the rest go on."""
    parts = []
    for name, make in tasks.items():
        try:
            parts.append(make().withColumn("task", F.lit(name)))
        except Exception as e:  # noqa: BLE001  one broken source must not stop an evaluation
            print(f"task {name} left out: {e}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tokenizer_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(token, id), (rank, left, right) of a tokenizer file in JSON, as pairs or as strings parted by a space."""
    raw = spark.read.text(path, wholetext=True)
    model = raw.select(F.from_json("value", "model struct<vocab: map<string, int>, merges: array<string>>").alias("j"))
    vocab = model.select(F.explode("j.model.vocab").alias("token", "id"))
    pair = F.coalesce(F.from_json("m", "array<string>"), F.split("m", " "))
    merges = model.select(F.posexplode("j.model.merges").alias("rank", "m")).select("rank", pair[0].alias("left"), pair[1].alias("right"))
    return vocab, merges
