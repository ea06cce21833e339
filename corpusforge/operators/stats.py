"""Statistics of corpora and token streams, stratified sampling, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.operators import packing


def token_histogram(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token_id, n over byte tokens and boundaries; each task sums its own before 257 rows of it are shuffled."""
    digits = F.regexp_extract_all(packing.byte_hex(F.coalesce(docs[text_col], F.lit(""))), F.lit(".."), F.lit(0))
    pair = docs.select(F.explode(digits).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    bos = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit(packing.BOS_ID).alias("token_id"), "n")
    return pair.select(F.conv("p", 16, 10).cast("int").alias("token_id"), "n").unionByName(bos)


def totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.coalesce(docs[text_col], F.lit(""))
    words = F.regexp_count(t, F.lit(r"\S+")).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length(t) + 1).cast("long").alias("byte_tokens"), F.sum(words).alias("word_tokens"), F.sum(F.octet_length(t)).cast("long").alias("utf8_bytes"))


def length_statistics(n: Column) -> list[Column]:
    """min, max, mean, population deviation, quartiles (linear interpolation) and their distance."""
    q = lambda p: F.percentile(n, F.lit(p))
    return [F.min(n).cast("long").alias("n_min"), F.max(n).cast("long").alias("n_max"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), q(0.25).alias("p25"), q(0.75).alias("p75"), (q(0.75) - q(0.25)).alias("iqr")]


def spans(positions: DataFrame, shortest: int = 8, longest: int = 100_000) -> DataFrame:
    """window, pos of boundaries -> window, start, n of the documents between consecutive ones, of allowed length."""
    nxt = F.lead("pos").over(W.partitionBy("window").orderBy("pos"))
    return positions.withColumn("next", nxt).where("next IS NOT NULL").select("window", (F.col("pos") + 1).alias("start"), (F.col("next") - F.col("pos") - 1).alias("n")).where(F.col("n").between(shortest, longest))


def quota(total: int, index: Column, parts: int) -> Column:
    """Even shares of total; the first (total mod parts) get one more."""
    return (F.lit(total // parts) + F.when(index < total % parts, 1).otherwise(0)).cast("long")


def hash_order(seed: str, key: Column) -> Column:
    """A shuffle key that any engine can compute."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def stratified(df: DataFrame, stratum: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each stratum, without replacement, by hash order."""
    rn = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key))
    return df.withColumn("rn", rn).where(F.col("rn") <= k)


def least_hashes(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k rows without replacement: those of the least hashes, found by each task's own k least."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(k)


def draws(df: DataFrame, batches: int, size: int, seed: str, key: str = "doc_id") -> DataFrame:
    """batch, place and the row drawn, with replacement: a hash of the place modulo the number of rows names a rank."""
    spark = df.sparkSession
    ranked = packing.with_offsets(df.select(F.col(key).alias("doc_id"), F.lit(1).cast("long").alias("one")), value="one", out="i")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    asked = spark.range(batches * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("place"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.concat_ws("-", "batch", "place"))), 1, 12), 16, 10).cast("long")
    picks = asked.crossJoin(F.broadcast(n)).where("n > 0").select("batch", "place", (h % F.col("n")).alias("i"))  # n is one row
    return picks.join(ranked, "i").select("batch", "place", F.col("doc_id").alias(key))


def checked_quota(total: int, held: DataFrame, stratum: str, n: str) -> DataFrame:
    """stratum, share: even shares of total in order of stratum; a stratum that holds less than its share is an error."""
    parts = held.count()
    ranked = held.withColumn("i", F.row_number().over(W.orderBy(stratum)) - 1).withColumn("share", quota(total, F.col("i"), max(parts, 1)))
    short = F.raise_error(F.concat(F.lit("too few rows in stratum "), F.col(stratum).cast("string"))).cast("long")
    return ranked.select(stratum, F.when(F.col(n) >= F.col("share"), F.col("share")).otherwise(short).alias("share"))


def hash_rank(df: DataFrame, key: Column, seed: str, *ties: str, out: str = "rank", digits: int = 4) -> DataFrame:
    """Adds the row's place from 0 in hash order: a histogram of the leading digits, and the place within a bucket.

    No task orders the whole table: buckets are 16^digits, and only their counts meet in one.
    """
    h = df.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, digits))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).select("_b", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", *ties)) - 1
    return h.join(sums, "_b").withColumn(out, F.col("_before") + inside).drop("_h", "_b", "_before")


def split_by_hash(df: DataFrame, key: str, seed: str, validation: float = 0.05) -> DataFrame:
    """Adds split: a seeded shuffle cut at floor(n * (1 - validation)).

    The cut is found by a histogram of the leading hash digits and a rank within the one boundary bucket, so no task
    orders the whole table.
    """
    h = df.withColumn("h", hash_order(seed, F.col(key))).withColumn("b", F.substring("h", 1, 3))
    sums = h.groupBy("b").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("cut", F.floor(F.sum("c").over(W.partitionBy()) * F.lit(1.0 - validation)))
    placed = h.join(sums, "b").withColumn("rank", F.when(F.col("before") + F.col("c") <= F.col("cut"), F.lit(-1)).when(F.col("before") > F.col("cut"), F.lit(1 << 62)))
    inside = placed.where("rank IS NULL").withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", key)) - 1)
    whole = placed.where("rank IS NOT NULL").unionByName(inside)
    return whole.withColumn("split", F.when(F.col("rank") < F.col("cut"), "train").otherwise("val")).drop("b", "c", "before", "cut", "rank", "h")
