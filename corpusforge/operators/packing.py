"""Packing documents into one global stream of tokens, cut into blocks and shards.

A document's tokens are held as a fixed number of hex digits each, so slices of tokens are substrings and concatenation
is a string sum; arrays of integers appear only on demand (decode). The byte tokenizer writes two digits a byte and
`##` at the start of a document. Order is the document id; nothing depends on the partitioning.

The offset of a document is a prefix sum in two passes: sums by range of ids, a running sum over the few ranges, and a
running sum within each range. No single task sees all documents, and token text never takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.functions.text import byte_hex

BOS, BOS_ID, DIGITS = "##", 256, 2
RANGE = 1 << 16  # ids in a range of the prefix sum


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stream (the document's tokens), n (their number, the boundary included)."""
    stream = F.concat(F.lit(BOS), byte_hex(F.coalesce(docs[text_col], F.lit(""))))
    return docs.select(docs[id_col].alias("doc_id"), stream.alias("stream")).withColumn("n", (F.length("stream") / DIGITS).cast("long"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n: what the offsets need, without the tokens."""
    return docs.select(docs[id_col].alias("doc_id"), (F.octet_length(F.coalesce(docs[text_col], F.lit(""))) + 1).cast("long").alias("n"))


def with_offsets(counted: DataFrame, start: int = 0, value: str = "n", out: str = "off") -> DataFrame:
    """Adds `off`, the sum of n over all lesser doc_ids; with value a column of ones, the rank from 0.

    Null ids come first, as one range, in no order among themselves.
    """
    part = F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(-(1 << 62)).cast("long"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = counted.groupBy(part.alias("part")).agg(F.sum(value).alias("total"))
    base = sums.select("part", (F.coalesce(F.sum("total").over(before), F.lit(0)) + start).alias("base"))
    inside = W.partitionBy("part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("part", part).join(base, "part").withColumn(out, (F.col("base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("part", "base")


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """(doc_id, stream, n, off) -> one row for each document and block that it reaches into."""
    at = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("n") - 1) / block))))
    first = F.greatest(F.col("off"), F.col("block") * block)
    last = F.least(F.col("off") + F.col("n"), (F.col("block") + 1) * block)
    return at.select("block", "doc_id", (first - F.col("off")).alias("doc_start"), (last - first).alias("n_tokens"), F.substring("stream", ((first - F.col("off")) * DIGITS + 1).cast("int"), ((last - first) * DIGITS).cast("int")).alias("piece"))


def blocks(docs: DataFrame, block: int = 512, *, keep_tail: bool = False, first_block: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, stream, n_tokens. Blocks are independent of each other, so a resumed run computes only the missing ones."""
    offs = with_offsets(token_counts(docs, id_col, text_col)).drop("n")
    placed = tokens(docs, id_col, text_col).join(offs, "doc_id")
    cut = pieces(placed, block).where(F.col("block") >= first_block)
    # The pieces of a block are few: at most one for each of its tokens.
    joined = cut.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece"))).alias("p"), F.sum("n_tokens").alias("n_tokens"))
    out = joined.select("block", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("stream"), "n_tokens")
    return out if keep_tail else out.where(F.col("n_tokens") == block)


def decode(stream: Column) -> Column:
    """Token ids of a stream of byte tokens."""
    pair = F.regexp_extract_all(stream, F.lit("..|\\n"), F.lit(0))
    return F.transform(pair, lambda x: F.when(x == BOS, F.lit(BOS_ID)).otherwise(F.conv(x, 16, 10).cast("int")))


def token_at(stream: Column, index: int) -> Column:
    """First (0) or last (-1) token id."""
    digits = F.substring(stream, 1 if index == 0 else -DIGITS, DIGITS)
    return F.when(digits == BOS, F.lit(BOS_ID)).otherwise(F.conv(digits, 16, 10).cast("int"))


def n_bos(stream: Column) -> Column:
    return ((F.length(stream) - F.length(F.translate(stream, "#", ""))) / DIGITS).cast("long")


def max_token(stream: Column) -> Column:
    return F.when(stream.contains("#"), F.lit(BOS_ID)).otherwise(F.conv(F.array_max(F.regexp_extract_all(stream, F.lit(".."), F.lit(0))), 16, 10).cast("int"))


def with_shards(packed: DataFrame, blocks_per_shard: int = 8, val_shards: int = 1) -> DataFrame:
    shard = F.floor(F.col("block") / blocks_per_shard).cast("long")
    return packed.withColumn("shard", shard).withColumn("split", F.when(shard < val_shards, "val").otherwise("train"))


def shard_positions(docs: DataFrame, shard_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where a run that has written shards 0..s resumes: documents completed and tokens into the next one."""
    placed = with_offsets(with_offsets(token_counts(docs, id_col, text_col)).withColumn("one", F.lit(1).cast("long")), value="one", out="i")
    edge = placed.withColumn("shard", F.explode(F.expr(f"CASE WHEN floor(off / {shard_tokens}) <= floor((off + n - 1) / {shard_tokens}) THEN sequence(floor(off / {shard_tokens}), floor((off + n - 1) / {shard_tokens})) END")))
    inside = edge.where((F.col("shard") > 0) & (F.col("off") <= F.col("shard") * shard_tokens))
    return inside.select((F.col("shard") - 1).alias("shard"), F.col("i").cast("long").alias("completed_docs"), (F.col("shard") * shard_tokens - F.col("off")).alias("doc_token_offset"))
