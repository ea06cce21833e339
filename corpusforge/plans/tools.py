"""Queries: pruning of vocabularies, files and gates of a run, draws with and without replacement, small array work."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.functions import arrays, numeric, text
from corpusforge.operators import audit, packing, pruning, stats, vocabulary
from corpusforge.plans.base import query, table
from corpusforge.plans.models import REACH, SELECTED, VOCAB, merges_of, selected_of, stored, vocab
from corpusforge.sources import scratch
from corpusforge.plans.packing import FACTS, SHARDS, facts

SPECIALS = ("<pad>", "<eos>", "<bos>", "<unk>")
CUSTOM = ("<think>", "</think>")
KEYWORDS = ("the", "and", "of", "license", "return", "import", "zzzz")
VALUES = lambda tokens: "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(tokens)) + ") x(place, token))"


def with_specials(spark, v):
    """The vocabulary with the leading specials as if it had always had them: ids follow the others."""
    v = v.select("token", "id", "n")
    n = v.agg(F.count(F.lit(1)).cast("int").alias("size"))
    extra = pruning.token_list(spark, SPECIALS).crossJoin(F.broadcast(n)).select("token", (F.col("size") + F.col("place")).alias("id"), F.lit(0).cast("long").alias("n"))
    return v.unionByName(extra)


#: ws: the vocabulary with specials, c: what a pruned one keeps of it, r: its new numbering.
PRUNED = SELECTED + f", sp AS {VALUES(SPECIALS)}, cu AS {VALUES(CUSTOM)}, ws AS MATERIALIZED (SELECT token, id, n FROM v UNION ALL SELECT token, ((SELECT count(*) FROM v) + place)::INT, 0 FROM sp), o AS (SELECT token, 0 AS class, place::BIGINT AS pl FROM sp UNION ALL SELECT token, 1, place FROM cu UNION ALL SELECT token, 2, old_id FROM s), r AS MATERIALIZED (SELECT o.token, (row_number() OVER (ORDER BY class, pl) - 1)::INT AS new_id, ws.id AS old_id FROM o LEFT JOIN ws ON ws.token = o.token)"


def pruned(spark, v):
    return pruning.renumbered(selected_of(v).select("token"), with_specials(spark, v), pruning.token_list(spark, SPECIALS), pruning.token_list(spark, CUSTOM))


@query(PRUNED + " SELECT token, new_id, old_id FROM r")
def tokenizer_rewrite(spark, sf_dir):
    return pruned(spark, stored(spark, sf_dir))


@query(PRUNED + " SELECT ws.id AS old_id, coalesce(r.new_id, -1) AS new_id FROM ws LEFT JOIN r ON r.old_id = ws.id")
def tokenizer_inverse(spark, sf_dir):
    v = stored(spark, sf_dir)
    return pruning.inverse(pruned(spark, v), with_specials(spark, v))


@query(PRUNED + " SELECT r.new_id, r.token, ws.token AS old_token FROM r JOIN ws ON ws.id = r.old_id WHERE r.token <> ws.token")
def mapping_audit(spark, sf_dir):
    v = stored(spark, sf_dir)
    return pruning.mapping_errors(pruned(spark, v), with_specials(spark, v))


@query(PRUNED + " SELECT r.new_id, r.token, r.old_id AS teacher_id FROM r WHERE r.new_id < 64")
def vocab_teacher(spark, sf_dir):
    """The first 64 ids of the pruned vocabulary and the old ids that they stand for, null for custom specials."""
    return pruned(spark, stored(spark, sf_dir)).where("new_id < 64").select("new_id", "token", F.col("old_id").alias("teacher_id"))


@query(VOCAB + f" SELECT token FROM {VALUES(KEYWORDS)} k WHERE token NOT IN (SELECT token FROM v)")
def vocab_missing(spark, sf_dir):
    return pruning.missing(pruning.token_list(spark, KEYWORDS), vocab(spark, sf_dir))


@query(PRUNED + f" SELECT token FROM v WHERE length(token) = 1 UNION SELECT token FROM sp UNION SELECT token FROM {VALUES(KEYWORDS)} k WHERE token IN (SELECT token FROM v)")
def vocab_protected(spark, sf_dir):
    v = stored(spark, sf_dir)
    known = pruning.token_list(spark, KEYWORDS).join(v.select("token"), "token", "left_semi")
    return pruning.protected(with_specials(spark, v), pruning.token_list(spark, SPECIALS), known)


#: All prefixes of a selected token are selected, and letters always are; what can't be built holds a strange letter.
CHECKED = PRUNED + ", le AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(token, '')) AS c FROM s)), ca AS (SELECT m.* FROM m JOIN s a ON a.token = m.\"left\" JOIN s b ON b.token = m.\"right\" JOIN s c ON c.token = m.output)"


@query(
    CHECKED + " SELECT unnest(['size', 'dense_ids', 'tokens_once', 'specials_kept', 'atoms_kept', 'merges_closed', 'mapping_exact', 'leading_ids', 'reachable']) AS name, unnest(["
    "(SELECT count(*) FROM r) = (SELECT count(*) FROM s) + 6, (SELECT count(DISTINCT new_id) = count(*) AND min(new_id) = 0 AND max(new_id) = count(*) - 1 FROM r), (SELECT count(DISTINCT token) = count(*) FROM r), "
    "(SELECT count(*) FROM sp ANTI JOIN r USING (token)) = 0, (SELECT count(*) FROM v ANTI JOIN r USING (token) WHERE length(v.token) = 1) = 0, (SELECT count(*) FROM ca ANTI JOIN r ON r.token = ca.output) = 0, "
    "(SELECT count(*) FROM r JOIN ws ON ws.id = r.old_id WHERE r.token <> ws.token) = 0, (SELECT count(*) FROM r JOIN sp USING (token) WHERE new_id <> place) = 0, (SELECT count(*) FROM le WHERE c NOT IN (SELECT token FROM s WHERE length(token) = 1)) = 0]) AS ok"
)
def tokenizer_checks(spark, sf_dir):
    v = stored(spark, sf_dir)
    s = selected_of(v)
    atoms = v.where("length(token) = 1").select("token")
    kept = scratch.cut(vocabulary.kept_merges(merges_of(v).select("rank", "left", "right"), s), "kept-merges")
    renamed = scratch.cut(pruned(spark, v), "renamed")
    return pruning.checks(renamed, kept, with_specials(spark, v), atoms, pruning.token_list(spark, SPECIALS), s.count() + len(SPECIALS) + len(CUSTOM))


@query(PRUNED + " SELECT (SELECT count(*) FROM ws) AS before, (SELECT count(*) FROM r) AS after, (SELECT count(*) FROM m JOIN s a ON a.token = m.\"left\" JOIN s b ON b.token = m.\"right\" JOIN s c ON c.token = m.output) AS merges, (SELECT count(*) FROM ws ANTI JOIN r ON r.old_id = ws.id) AS dropped")
def vocab_prune(spark, sf_dir):
    v = stored(spark, sf_dir)
    r, w = pruned(spark, v), with_specials(spark, v)
    kept = vocabulary.kept_merges(merges_of(v).select("rank", "left", "right"), selected_of(v))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(w, "before").crossJoin(n(r, "after")).crossJoin(n(kept, "merges")).crossJoin(n(pruning.inverse(r, w).where("new_id < 0"), "dropped"))  # one row each


@query(REACH + " SELECT token, (length(token) - 1 + len(list_distinct(string_split(token, ''))))::INT AS closure_size FROM s WHERE length(token) > 1 AND token NOT IN (SELECT token FROM lost)")
def vocab_closure(spark, sf_dir):
    """How many tokens each one that can be built needs with itself: its prefixes and its letters; merges are one model's list."""
    v = stored(spark, sf_dir)
    s = selected_of(v)
    rows = s.select("token").collect()
    made = vocabulary.kept_merges(merges_of(v).select("rank", "left", "right"), s).collect()
    tokens = {r["token"] for r in rows}
    found = vocabulary.closures([(r["rank"], r["left"], r["right"]) for r in made], tokens, {t for t in tokens if len(t) == 1})
    return spark.createDataFrame([(t, len(x)) for t, x in found.items() if len(t) > 1], "token string, closure_size int")


@query("SELECT name, coalesce(CASE WHEN wanted IS NOT NULL THEN CASE WHEN list_contains(known, wanted) THEN wanted END WHEN list_contains(known, '<bos>') THEN '<bos>' WHEN list_contains(known, '<|bos|>') THEN '<|bos|>' END, 'none') AS boundary FROM (VALUES ('a', NULL, ['<bos>', '<|bos|>']), ('b', NULL, ['<|bos|>']), ('c', '<s>', ['<s>', '<bos>']), ('d', '<s>', ['<bos>']), ('e', NULL, ['x'])) t(name, wanted, known)")
def boundary_token(spark, sf_dir):
    rows = [("a", None, ["<bos>", "<|bos|>"]), ("b", None, ["<|bos|>"]), ("c", "<s>", ["<s>", "<bos>"]), ("d", "<s>", ["<bos>"]), ("e", None, ["x"])]
    t = spark.createDataFrame(rows, "name string, wanted string, known array<string>")
    asked = F.when(F.col("wanted").isNotNull(), F.array("wanted")).otherwise(F.array(F.lit("<bos>"), F.lit("<|bos|>")))
    return t.select("name", F.coalesce(pruning.first_known(asked, F.col("known")), F.lit("none")).alias("boundary"))


@query(VOCAB + " SELECT count(*) AS ids, max(id)::BIGINT AS max_id, sum(n)::BIGINT AS tokens, max(id) < count(*) AS fits FROM v")
def counts_check(spark, sf_dir):
    return vocab(spark, sf_dir).agg(F.count(F.lit(1)).alias("ids"), F.max("id").cast("long").alias("max_id"), F.sum("n").alias("tokens"), (F.max("id") < F.count(F.lit(1))).alias("fits"))


# Runs and their files.


def shards(spark, sf_dir):
    return audit.by_shard(facts(spark, sf_dir))


@query(SHARDS + " SELECT split, shard FROM sh WHERE split = 'val' UNION ALL SELECT split, shard FROM sh WHERE split = 'train'")
def shard_lists(spark, sf_dir):
    s = shards(spark, sf_dir).select("split", "shard")
    return s.where("split = 'val'").unionByName(s.where("split = 'train'"))


@query(SHARDS + " SELECT DISTINCT 'data/' || split AS root FROM sh")
def data_roots(spark, sf_dir):
    return shards(spark, sf_dir).select(F.concat(F.lit("data/"), "split").alias("root")).distinct()


NAME = "'corpus_' || split || '_' || lpad(shard::VARCHAR, 6, '0') || '.bin'"


@query(SHARDS + f" SELECT {NAME} AS name FROM sh ORDER BY name LIMIT 16")
def first_shards(spark, sf_dir):
    """The first 16 paths in order of name, which an audit of a few shards reads."""
    return shards(spark, sf_dir).select(text.shard_name("corpus", F.col("split"), F.col("shard")).alias("name")).orderBy("name").limit(16)


@query(FACTS + " SELECT block, shard FROM f WHERE n_bos = 0 ORDER BY block LIMIT 20")
def bad_examples(spark, sf_dir):
    """The first 20 blocks without a document's start, for a report."""
    return packing.with_shards(facts(spark, sf_dir)).where("n_bos = 0").select("block", "shard").orderBy("block").limit(20)


@query(SHARDS + " SELECT count(*) AS found, (max(shard) + 1)::BIGINT AS next_shard, count(*) = max(shard) + 1 AS consistent, greatest(1000 - count(*), 0)::BIGINT AS remaining FROM sh")
def resume_gate(spark, sf_dir):
    """What a resumed run checks: shards there against the state's next one, and how many of 1,000 are left to make."""
    return audit.resume_gate(shards(spark, sf_dir), shards(spark, sf_dir).agg((F.max("shard") + 1).alias("next_shard")), 1000)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def text_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("SELECT conv_id, turn, lower(trim(text)) IN ('stop', 'exit', 'quit', 'ok', 'thanks') AS stops FROM conversations")
def stop_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).isin("stop", "exit", "quit", "ok", "thanks").alias("stops"))


@query("WITH x AS (SELECT source, unnest(regexp_extract_all(text, '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[a-z]+'), 1) AS i FROM documents), k AS (SELECT source, w, min(i) AS i FROM x GROUP BY source, w) SELECT source, count(*) AS words, coalesce(string_agg(w, ' ' ORDER BY w) FILTER (WHERE i <= 3), '') AS opening FROM k GROUP BY source")
def keyword_corpus(spark, sf_dir):
    """For each source its number of different words, and the different opening words in order."""
    words = table(spark, sf_dir, "documents").select("source", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("w"))
    every = words.select("source", F.posexplode("w").alias("pos", "word")).groupBy("source", "word").agg(F.min("pos").alias("pos"))
    opening = F.array_join(F.array_sort(F.collect_list(F.when(F.col("pos") < 3, F.col("word")))), " ")
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("words"), opening.alias("opening"))


# Draws.


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5('s' || doc_id::VARCHAR), doc_id LIMIT 200")
def sample_rows(spark, sf_dir):
    """200 rows without replacement: those of the least hashes."""
    return stats.least_hashes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 200, "s")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), k AS (SELECT b AS batch, j AS place, ('0x' || left(md5('r' || b::VARCHAR || '-' || j::VARCHAR), 12))::BIGINT AS h FROM range(32) x(b), range(16) y(j)) SELECT batch, place, d.doc_id FROM k JOIN d ON d.i = k.h % d.n")
def sample_batches(spark, sf_dir):
    """32 batches of 16 draws with replacement."""
    return stats.draws(table(spark, sf_dir, "documents").select("doc_id"), 32, 16, "r")


# Arrays.


@query("SELECT vec_id, [round(embedding[i]::DOUBLE, 5) for i in [1, 4, 2, 2]] AS picked FROM embeddings")
def array_gather(spark, sf_dir):
    some = F.array(*[F.lit(i) for i in (0, 3, 1, 1)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(arrays.gather(F.col("embedding"), some), lambda x: numeric.rounded(x.cast("double"), 5)).alias("picked"))


@query("SELECT vec_id, k::INT AS copy FROM embeddings, range(4) t(k)")
def array_copies(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("copy"))


@query("WITH t AS (SELECT doc_id, [strlen(x)::INT for x in regexp_extract_all(text, '[a-z]+')[1:40]] AS ids FROM documents), b AS (SELECT doc_id, ids, max(len(ids)) OVER (PARTITION BY doc_id // 8) AS width FROM t) SELECT doc_id, list_concat(ids, [0 for i in range(width - len(ids))]) AS inputs, list_concat(ids, [-100 for i in range(width - len(ids))]) AS labels FROM b")
def batch_labels(spark, sf_dir):
    """Batches of 8 documents: the lengths of their first 40 words, padded by 0, and as labels by -100."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), 1, 40)
    t = table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda x: F.length(x)).alias("ids"))
    width = F.max(F.size("ids")).over(W.partitionBy(F.floor(F.col("doc_id") / 8)))
    return t.withColumn("width", width).select("doc_id", arrays.pad_right(F.col("ids"), F.col("width"), 0).alias("inputs"), arrays.pad_right(F.col("ids"), F.col("width"), -100).alias("labels"))


@query(FACTS + " SELECT shard, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens - n_bos)::BIGINT AS bytes, round(sum(n_tokens - n_bos) / sum(n_tokens)::DOUBLE, 6) AS bytes_per_token FROM f GROUP BY shard")
def bytes_per_token(spark, sf_dir):
    """Bytes that a shard's ids decode to without the boundary, by ids with it."""
    s = shards(spark, sf_dir)
    return s.select("shard", F.col("n_tokens").alias("tokens"), (F.col("n_tokens") - F.col("n_bos")).alias("bytes"), F.round((F.col("n_tokens") - F.col("n_bos")) / F.col("n_tokens"), 6).alias("bytes_per_token"))


@query("SELECT round(avg(strlen(text) / 100.0::DOUBLE), 6) AS loss, count(*) AS steps FROM documents WHERE text IS NOT NULL")
def eval_mean(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").agg(F.round(F.avg(F.octet_length("text") / 100.0), 6).alias("loss"), F.count(F.lit(1)).alias("steps"))


@query("SELECT doc_id, strlen(text)::BIGINT + 2 AS n FROM documents WHERE strlen(text) + 2 <= 1024")
def length_filter(spark, sf_dir):
    """Documents that fit 1,024 tokens with a start and an end."""
    n = F.octet_length("text").cast("long") + 2
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n <= 1024")
