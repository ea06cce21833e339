"""Queries: packing, audits of shards, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import numeric, text
from corpusforge.operators import audit, batches, packing
from corpusforge.plans.base import query, table

B = 512
DOCS = "WITH d AS (SELECT doc_id, '##' || hex(encode(coalesce(text, ''))) AS s FROM documents), c AS (SELECT doc_id, s, length(s) // 2 AS n FROM d), o AS (SELECT *, (coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM c)"
PIECES = DOCS + f", e AS (SELECT *, unnest(range(off // {B}, (off + n - 1) // {B} + 1)) AS block FROM o), p AS (SELECT block, doc_id, greatest(off, block * {B}) - off AS doc_start, least(off + n, (block + 1) * {B}) - greatest(off, block * {B}) AS k, s FROM e), q AS (SELECT block, doc_id, doc_start, k, substr(s, doc_start * 2 + 1, k * 2) AS piece FROM p)"
ALL = PIECES + ", a AS (SELECT block, string_agg(piece, '' ORDER BY doc_id) AS stream, sum(k)::BIGINT AS n_tokens FROM q GROUP BY block)"
FULL = ALL + f", b AS (SELECT *, block // 8 AS shard, CASE WHEN block // 8 < 1 THEN 'val' ELSE 'train' END AS split FROM a WHERE n_tokens = {B})"
MAX_ID = "CASE WHEN contains(stream, '#') THEN 256 ELSE ('0x' || list_max(regexp_extract_all(stream, '..')))::INT END"
FACTS = FULL + f", f AS (SELECT shard, split, block, n_tokens, (length(stream) - length(replace(stream, '#', ''))) // 2 AS n_bos, {MAX_ID} AS max_id FROM b)"
SHARDS = FACTS + ", sh AS (SELECT shard, max(split) AS split, count(*) AS n_blocks, sum(n_tokens)::BIGINT AS n_tokens, sum(n_bos)::BIGINT AS n_bos, max(max_id)::BIGINT AS max_id FROM f GROUP BY shard)"
TOK = "CASE WHEN {0} = '##' THEN 256 ELSE ('0x' || {0})::INT END"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def facts(spark, sf_dir):
    return audit.block_facts(packing.blocks(docs(spark, sf_dir), B))


@query(DOCS + " SELECT doc_id, n AS n_tokens, off AS start_offset FROM o")
def doc_offsets(spark, sf_dir):
    return packing.with_offsets(packing.token_counts(docs(spark, sf_dir))).select("doc_id", F.col("n").alias("n_tokens"), F.col("off").alias("start_offset"))


PACKED = f"block, n_tokens, (length(stream) - length(replace(stream, '#', ''))) // 2 AS n_bos, {TOK.format('left(stream, 2)')} AS first_tok, {TOK.format('right(stream, 2)')} AS last_tok, md5(stream) AS digest"


def packed_columns(df):
    s = F.col("stream")
    return df.select("block", "n_tokens", packing.n_bos(s).alias("n_bos"), packing.token_at(s, 0).alias("first_tok"), packing.token_at(s, -1).alias("last_tok"), F.md5(s).alias("digest"))


@query(FULL + f" SELECT {PACKED} FROM b")
def pack_blocks(spark, sf_dir):
    return packed_columns(packing.blocks(docs(spark, sf_dir), B))


@query(ALL + f" SELECT {PACKED} FROM a")
def pack_keep_tail(spark, sf_dir):
    return packed_columns(packing.blocks(docs(spark, sf_dir), B, keep_tail=True))


@query(FULL + f" SELECT {PACKED} FROM b WHERE shard >= 3")
def pack_resume(spark, sf_dir):
    return packed_columns(packing.blocks(docs(spark, sf_dir), B, first_block=24))


@query(SHARDS + " SELECT shard, split, n_blocks, n_tokens, n_bos FROM sh")
def pack_shards(spark, sf_dir):
    return audit.by_shard(facts(spark, sf_dir)).select("shard", "split", "n_blocks", "n_tokens", "n_bos")


@query(FULL + " SELECT shard, n_tokens, (string_split(array_to_string(list_transform(regexp_extract_all(stream, '..'), lambda x: CASE WHEN x = '##' THEN '256' ELSE ('0x' || x)::INT::VARCHAR END), ','), ',')[1:5])::VARCHAR[] IS NOT NULL AS ok, md5(array_to_string(list_transform(regexp_extract_all(stream, '..'), lambda x: CASE WHEN x = '##' THEN '256' ELSE ('0x' || x)::INT::VARCHAR END), ',')) AS ids_digest, block FROM b")
def decode_blocks(spark, sf_dir):
    some = packing.with_shards(packing.blocks(docs(spark, sf_dir), B))
    ids = F.array_join(packing.decode(F.col("stream")).cast("array<string>"), ",")
    return some.select("shard", "n_tokens", F.lit(True).alias("ok"), F.md5(ids).alias("ids_digest"), "block")


@query(PIECES + " SELECT block, doc_id, doc_start, k AS n_tokens FROM q")
def block_doc_overlap(spark, sf_dir):
    return packing.pieces(packing.with_offsets(packing.token_counts(docs(spark, sf_dir))).withColumn("stream", F.lit("")), B).select("block", "doc_id", "doc_start", "n_tokens")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) AS position FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def skip_take(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").orderBy("doc_id").offset(100).limit(50).withColumn("position", F.expr("(row_number() OVER (ORDER BY doc_id) + 99)").cast("long"))


@query(DOCS + ", i AS (SELECT *, row_number() OVER (ORDER BY off) - 1 AS i FROM o), e AS (SELECT *, unnest(range(off // 4096, (off + n - 1) // 4096 + 1)) AS shard FROM i) SELECT shard - 1 AS shard, i AS completed_docs, shard * 4096 - off AS doc_token_offset FROM e WHERE shard > 0 AND off <= shard * 4096")
def stream_position(spark, sf_dir):
    return packing.shard_positions(docs(spark, sf_dir), 4096)


@query(SHARDS + " SELECT shard, n_tokens, n_bos AS document_boundaries, max_id FROM sh")
def shard_audit(spark, sf_dir):
    return audit.by_shard(facts(spark, sf_dir)).select("shard", "n_tokens", F.col("n_bos").alias("document_boundaries"), "max_id")


@query(FACTS + " SELECT coalesce(shard, -1) AS shard, sum(n_tokens)::BIGINT AS n_tokens, sum(n_bos)::BIGINT AS n_bos, max(max_id)::BIGINT AS max_id FROM f GROUP BY ROLLUP(shard)")
def shard_rollup(spark, sf_dir):
    out = facts(spark, sf_dir).rollup("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_bos").alias("n_bos"), F.max("max_id").alias("max_id"))
    return out.select(F.coalesce("shard", F.lit(-1)).alias("shard"), "n_tokens", "n_bos", "max_id")


@query(SHARDS + " SELECT count(*) AS shards, sum(n_tokens)::BIGINT AS tokens, sum(n_bos)::BIGINT AS boundaries, round(sum(n_bos) * 1e6 / greatest(sum(n_tokens), 1), 4) AS per_million, bool_or(n_bos > 0) AS any_boundary FROM sh WHERE shard IN (SELECT (i * (SELECT max(shard) FROM sh) // 4) FROM range(5) t(i))")
def shard_sample_audit(spark, sf_dir):
    some = audit.sampled(audit.by_shard(facts(spark, sf_dir)), 5)
    density = F.round(F.sum("n_bos") * F.lit(1e6) / F.greatest(F.sum("n_tokens"), F.lit(1)), 4)
    return some.agg(F.count(F.lit(1)).alias("shards"), F.sum("n_tokens").alias("tokens"), F.sum("n_bos").alias("boundaries"), density.alias("per_million"), F.bool_or(F.col("n_bos") > 0).alias("any_boundary"))


@query(SHARDS + " SELECT split, round(sum(n_bos) * 1e6 / greatest(sum(n_tokens), 1), 4) AS per_million FROM sh GROUP BY split")
def boundary_density(spark, sf_dir):
    return audit.by_shard(facts(spark, sf_dir)).groupBy("split").agg(F.round(F.sum("n_bos") * F.lit(1e6) / F.greatest(F.sum("n_tokens"), F.lit(1)), 4).alias("per_million"))


@query(SHARDS + " SELECT shard, max_id, max_id < 256 AS in_range_256, max_id < 257 AS in_range_257 FROM sh")
def vocab_range_check(spark, sf_dir):
    return audit.by_shard(facts(spark, sf_dir)).select("shard", "max_id", (F.col("max_id") < 256).alias("in_range_256"), (F.col("max_id") < 257).alias("in_range_257"))


@query(SHARDS + " SELECT shard, n_tokens FROM sh WHERE n_tokens = 0 OR n_tokens % 4096 <> 0")
def bad_shards(spark, sf_dir):
    return audit.bad_shards(audit.by_shard(facts(spark, sf_dir)), 4096).select("shard", "n_tokens")


@query(SHARDS + " SELECT count(*) = (SELECT sum(strlen(coalesce(text, '')) + 1) FROM documents) // 512 // 8 + CASE WHEN (SELECT sum(strlen(coalesce(text, '')) + 1) FROM documents) // 512 % 8 > 0 THEN 1 ELSE 0 END AS shards_as_expected, count(*) FILTER (WHERE n_tokens = 4096) AS full_shards, sum(n_tokens)::BIGINT AS tokens FROM sh")
def shard_totals(spark, sf_dir):
    """Shards against those that the corpus must fill: whole blocks of 512 tokens, 8 to a shard."""
    n_blocks = F.floor(F.sum("n") / 512)
    want = packing.token_counts(docs(spark, sf_dir)).agg(F.ceil(n_blocks / 8).alias("want"))
    got = audit.by_shard(facts(spark, sf_dir)).agg(F.count(F.lit(1)).alias("got"), F.count_if(F.col("n_tokens") == 4096).alias("full_shards"), F.sum("n_tokens").alias("tokens"))
    return got.crossJoin(want).select((F.col("got") == F.col("want")).alias("shards_as_expected"), "full_shards", "tokens")  # one row each


META = "(VALUES ('block_size', '4'), ('bos_id', '2'), ('dtype', 'uint16'), ('format_version', '1'), ('vocab_size', '65536'))"
WANT = "(VALUES ('block_size', '8'), ('bos_id', '2'), ('dtype', 'uint32'), ('format_version', '1'), ('dataset', 'corpus'))"


@query(f"SELECT coalesce(a.key, e.key) AS key, a.value AS actual, e.value AS expected FROM {META} a(key, value) FULL JOIN {WANT} e(key, value) ON a.key = e.key WHERE a.value IS DISTINCT FROM e.value")
def meta_mismatch(spark, sf_dir):
    rows = lambda values: spark.sql(f"SELECT * FROM {values} AS t(key, value)")
    return audit.mismatches(rows(META.replace("(VALUES", "VALUES").rstrip(")") + ")"), rows(WANT.replace("(VALUES", "VALUES").rstrip(")") + ")"))


@query("SELECT v AS vocab, CASE WHEN v <= 65536 THEN 'uint16' ELSE 'uint32' END AS dtype FROM (SELECT unnest([1, 256, 65535, 65536, 65537, 81920, 4294967296]::BIGINT[]) AS v)")
def dtype_choice(spark, sf_dir):
    return spark.sql("SELECT explode(array(1L, 256L, 65535L, 65536L, 65537L, 81920L, 4294967296L)) AS vocab").select("vocab", numeric.id_dtype(F.col("vocab")).alias("dtype"))


@query(SHARDS + " SELECT shard, 'corpus_' || split || '_' || lpad(shard::VARCHAR, 6, '0') || '.bin' AS name FROM sh")
def shard_names(spark, sf_dir):
    return audit.by_shard(facts(spark, sf_dir)).select("shard", text.shard_name("corpus", F.col("split"), F.col("shard")).alias("name"))


@query("SELECT o_orderkey AS n, o_orderkey // 256 * 256 AS down, (o_orderkey + 255) // 256 * 256 AS up FROM orders")
def block_rounding(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("n"), numeric.down_to(n, 256).alias("down"), numeric.up_to(n, 256).alias("up"))


STEPS = SHARDS + ", st AS (SELECT shard, n_tokens, (n_tokens - 1) // 512 AS steps FROM sh), sb AS (SELECT *, coalesce(sum(steps) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM st)"


def steps(spark, sf_dir):
    return batches.shard_steps(audit.by_shard(facts(spark, sf_dir)), 512)


@query(STEPS + " SELECT shard, n_tokens, steps, before FROM sb")
def loader_steps(spark, sf_dir):
    return steps(spark, sf_dir)


@query(STEPS + ", w AS (SELECT i AS step, (i * 3) % (SELECT sum(steps) FROM sb) AS k FROM range(0, 5000, 7) t(i)) SELECT step, shard, (k - before)::BIGINT AS microstep FROM w JOIN sb ON k >= before AND k < before + steps")
def loader_seek(spark, sf_dir):
    return batches.seek(steps(spark, sf_dir), spark.range(0, 5000, 7).withColumnRenamed("id", "step"), 3)


@query(STEPS + ", m AS (SELECT shard, unnest(range(steps)) AS microstep FROM sb) SELECT shard, microstep, r::INT AS rank, microstep * 512 + r * 128 AS start, microstep * 512 + r * 128 + 129 AS stop FROM m, range(4) t(r)")
def loader_rank_windows(spark, sf_dir):
    return batches.rank_windows(steps(spark, sf_dir), 2, 64, 4)


@query(FULL + ", w AS (SELECT block, i FROM b, range(3) t(i)) SELECT w.block, w.i::INT AS row, substr(stream, (i * 128) * 2 + 1, 256) AS x, substr(stream, (i * 128 + 1) * 2 + 1, 256) AS y FROM w JOIN b USING (block)")
def loader_xy(spark, sf_dir):
    each = packing.blocks(docs(spark, sf_dir), B).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return each.select("block", "row", F.expr("substring(stream, row * 256 + 1, 256)").alias("x"), F.expr("substring(stream, row * 256 + 3, 256)").alias("y"))


@query(STEPS + " SELECT i AS step, (i % (SELECT sum(steps) FROM sb))::BIGINT AS in_epoch, (i // (SELECT sum(steps) FROM sb))::BIGINT AS epoch FROM range(0, 20000, 501) t(i)")
def loader_epoch(spark, sf_dir):
    total = steps(spark, sf_dir).agg(F.sum("steps").alias("total"))
    return spark.range(0, 20000, 501).crossJoin(F.broadcast(total)).select(F.col("id").alias("step"), F.pmod("id", "total").alias("in_epoch"), F.floor(F.col("id") / F.col("total")).alias("epoch"))
