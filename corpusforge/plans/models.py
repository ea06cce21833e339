"""Queries: vocabularies and accounting of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import numeric, text
from corpusforge.operators import runs, vocabulary
from corpusforge.plans.base import query, table
from corpusforge.sources import scratch

# A vocabulary that any engine can build: words of letters (longer runs in pieces of 30) with their prefixes, each made
# from the one before.
VOCAB = "WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{1,30}')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), x AS (SELECT left(w, k) AS token, n FROM c, range(1, 31) t(k) WHERE k <= length(w)), t AS MATERIALIZED (SELECT token, sum(n)::BIGINT AS n FROM x GROUP BY token), v AS MATERIALIZED (SELECT token, n, (row_number() OVER (ORDER BY length(token), token) - 1)::INT AS id FROM t), m AS MATERIALIZED (SELECT left(token, length(token) - 1) AS \"left\", right(token, 1) AS \"right\", token AS output, row_number() OVER (ORDER BY length(token), token) - 1 AS rank FROM t WHERE length(token) > 1)"


def vocab(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{1,30}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    w = scratch.cut(w, "words")
    near = w.repartitionByRange(vocabulary.ranges(w), "w")  # words that share prefixes meet, and no task gets all of them
    x = near.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("token"), "n")
    return vocabulary.numbered(x.groupBy("token").agg(F.sum("n").alias("n")), "id", F.length("token"), "token")


def stored(spark, sf_dir):
    """The vocabulary, written once for queries that use it more than once."""
    return scratch.cut(vocab(spark, sf_dir), "vocab")


def merges_of(v):
    """The merges of a vocabulary, in the order of its ids, which has tokens of one letter first."""
    letters = v.where("length(token) = 1").agg(F.count(F.lit(1)).alias("letters"))
    t = v.where("length(token) > 1").crossJoin(F.broadcast(letters))  # one row
    return t.select(F.expr("left(token, length(token) - 1)").alias("left"), F.expr("right(token, 1)").alias("right"), F.col("token").alias("output"), (F.col("id") - F.col("letters")).cast("long").alias("rank"))


def merges(spark, sf_dir):
    return merges_of(vocab(spark, sf_dir))


SELECTED = VOCAB + ", s AS MATERIALIZED (SELECT token, id AS old_id, n, CASE WHEN length(token) = 1 THEN 0 ELSE 1 END AS class FROM v WHERE length(token) = 1 OR n >= 20)"


def selected_of(v):
    v = v.where("length(token) = 1 OR n >= 20")
    return v.select("token", F.col("id").alias("old_id"), "n", F.when(F.length("token") == 1, 0).otherwise(1).alias("class"))


def selected(spark, sf_dir):
    return selected_of(vocab(spark, sf_dir))


@query(VOCAB + " SELECT token, id, n FROM v")
def vocab_counts(spark, sf_dir):
    return vocab(spark, sf_dir).select("token", "id", "n")


@query(VOCAB + " SELECT count(id) AS n_ids, count(DISTINCT id) AS n_distinct, max(id)::BIGINT AS max_id, count(id) = count(DISTINCT id) AND count(id) = max(id) + 1 AS dense FROM v")
def vocab_dense(spark, sf_dir):
    from corpusforge.operators.audit import dense_ids

    return dense_ids(vocab(spark, sf_dir))


ODD = ["<0x00>", "<0xFF>", "<0xff>", "x<0x00>", "<unused7>", "<unused>", "<|end|>", "torch.nn.Linear", "λ = 3.0", "汉字", "مرحبا", "▁hello", "привет", "\n\n", "\n ", "a", "é"]
ODD_SQL = "(SELECT unnest([" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in ODD) + "]) AS token)"
FOREIGN = "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in text.SCRIPTS) + "]"


def odd(spark):
    return spark.createDataFrame([(x,) for x in ODD], "token string")


@query(f"SELECT token, regexp_full_match(token, '<0x[0-9A-F]{{2}}>') AS byte_piece, length(token) = 1 OR regexp_full_match(token, '<0x[0-9A-F]{{2}}>') AS atom, regexp_matches(token, '{FOREIGN}') AS foreign, CASE WHEN regexp_full_match(token, '<0x[0-9A-F]{{2}}>') THEN 1 ELSE strlen(replace(token, '▁', ' ')) END AS n_bytes, length(token) > 0 AND replace(token, chr(10), '') = '' AS line_feeds FROM {ODD_SQL}")
def token_predicates(spark, sf_dir):
    t = F.col("token")
    return odd(spark).select(t, text.is_byte_piece(t).alias("byte_piece"), text.is_atom(t).alias("atom"), text.has_foreign_script(t).alias("foreign"), text.piece_bytes(t).alias("n_bytes"), text.is_run_of(t, "\n").alias("line_feeds"))


@query(f"SELECT token, token IN ('汉字', '<|end|>') OR NOT (token IN ('a') OR regexp_full_match(token, '<unused[0-9]+>') OR starts_with(token, '<|') OR ends_with(token, '|>') OR regexp_matches(token, '{FOREIGN}')) AS eligible FROM {ODD_SQL}")
def vocab_eligible(spark, sf_dir):
    t = F.col("token")
    return odd(spark).select(t, vocabulary.eligible(t, t.isin("汉字", "<|end|>"), t.isin("a")).alias("eligible"))


@query(VOCAB + " SELECT token, round(n * (1 + log2(greatest(1, strlen(token) - 1))), 6) AS utility, row_number() OVER (ORDER BY round(n * (1 + log2(greatest(1, strlen(token) - 1))), 6) DESC, n DESC, id) AS place FROM v QUALIFY place <= 500")
def vocab_utility_rank(spark, sf_dir):
    return vocabulary.ranked(vocab(spark, sf_dir)).where("place <= 500").select("token", "utility", F.col("place").cast("long").alias("place"))


@query(SELECTED + " SELECT count(*) AS selected, sum(n)::BIGINT AS mass, round(sum(n) / (SELECT sum(n) FROM v), 6) AS share FROM s")
def vocab_mass(spark, sf_dir):
    v = stored(spark, sf_dir)
    total = v.agg(F.sum("n").alias("total"))
    return selected_of(v).agg(F.count(F.lit(1)).alias("selected"), F.sum("n").alias("mass")).crossJoin(F.broadcast(total)).select("selected", "mass", F.round(F.col("mass") / F.col("total"), 6).alias("share"))


@query(SELECTED + " SELECT token, old_id, (row_number() OVER (ORDER BY class, old_id) - 1)::INT AS new_id FROM s")
def vocab_remap(spark, sf_dir):
    return vocabulary.remapped(selected(spark, sf_dir)).select("token", "old_id", "new_id")


@query(SELECTED + ", r AS (SELECT old_id, (row_number() OVER (ORDER BY class, old_id) - 1)::INT AS new_id FROM s) SELECT v.id AS old_id, coalesce(r.new_id, -1) AS new_id FROM v LEFT JOIN r ON r.old_id = v.id")
def vocab_inverse(spark, sf_dir):
    v = stored(spark, sf_dir)
    new = vocabulary.remapped(selected_of(v)).select("old_id", "new_id")
    return v.select(F.col("id").alias("old_id")).join(new, "old_id", "left").select("old_id", F.coalesce("new_id", F.lit(-1)).alias("new_id"))


@query(SELECTED + ' SELECT rank, "left", "right", output FROM m JOIN s a ON a.token = m."left" JOIN s b ON b.token = m."right" JOIN s c ON c.token = m.output')
def merge_filter(spark, sf_dir):
    v = stored(spark, sf_dir)
    return vocabulary.kept_merges(merges_of(v).select("rank", "left", "right"), selected_of(v))


@query(SELECTED + ', k AS (SELECT rank, "left", "right", "left" IN (SELECT token FROM s) AS has_left, "right" IN (SELECT token FROM s) AS has_right, output IN (SELECT token FROM s) AS has_output FROM m) SELECT * FROM k WHERE NOT (has_left AND has_right AND has_output)')
def merge_violations(spark, sf_dir):
    v = stored(spark, sf_dir)
    return vocabulary.violations(merges_of(v).select("rank", "left", "right"), selected_of(v))


# Every prefix of a selected token is selected too, so what can't be built holds a letter that isn't.
REACH = SELECTED + ", lost AS (SELECT DISTINCT token FROM (SELECT token, unnest(string_split(token, '')) AS c FROM s) WHERE c NOT IN (SELECT token FROM s WHERE length(token) = 1))"


@query(REACH + " SELECT token FROM s WHERE token NOT IN (SELECT token FROM lost)")
def vocab_reach(spark, sf_dir):
    v = stored(spark, sf_dir)
    s = selected_of(v)
    kept = vocabulary.kept_merges(merges_of(v).select("rank", "left", "right"), s)
    return vocabulary.reachable(s.where("length(token) = 1"), kept)


@query(REACH + " SELECT token FROM lost")
def vocab_unreachable(spark, sf_dir):
    v = stored(spark, sf_dir)
    s = selected_of(v)
    kept = vocabulary.kept_merges(merges_of(v).select("rank", "left", "right"), s)
    return s.select("token").join(vocabulary.reachable(s.where("length(token) = 1"), kept), "token", "left_anti")


@query(SELECTED + ", b AS (SELECT DISTINCT substr(token, i, k) AS piece FROM (SELECT token FROM s WHERE length(token) BETWEEN 2 AND 6), range(1, 7) a(i), range(1, 7) b(k) WHERE i + k - 1 <= length(token)) SELECT piece FROM b WHERE piece IN (SELECT token FROM s)")
def substr_closure(spark, sf_dir):
    s = selected(spark, sf_dir)
    t = s.where("length(token) BETWEEN 2 AND 6").select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("i"))
    sub = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - F.col("i") + 1), lambda k: F.substring("token", F.col("i"), k))).alias("piece")).distinct()
    return sub.join(s.select(F.col("token").alias("piece")), "piece", "left_semi")


@query(SELECTED + ", d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS pos FROM documents), r AS (SELECT token, (row_number() OVER (ORDER BY class, old_id) - 1)::INT AS new_id FROM s) SELECT doc_id, md5(string_agg(coalesce(new_id, -1)::VARCHAR, ',' ORDER BY pos)) AS ids FROM d LEFT JOIN r USING (token) GROUP BY doc_id")
def mapped_sequence(spark, sf_dir):
    new = vocabulary.remapped(selected(spark, sf_dir)).select("token", "new_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "token"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new_id", F.lit(-1)).alias("id")))), lambda x: x["id"].cast("string"))
    return d.join(new, "token", "left").groupBy("doc_id").agg(F.md5(F.array_join(ids, ",")).alias("ids"))


@query(SELECTED + " SELECT (SELECT count(*) FROM (SELECT token FROM v EXCEPT SELECT token FROM s)) AS dropped, (SELECT count(*) FROM (SELECT token FROM s EXCEPT SELECT token FROM v)) AS strange, (SELECT count(*) FROM (SELECT token FROM s GROUP BY token HAVING count(*) > 1)) AS doubled")
def vocab_set_checks(spark, sf_dir):
    every = stored(spark, sf_dir)
    v, s = every.select("token"), selected_of(every).select("token")
    parts = [v.exceptAll(s).distinct().agg(F.count(F.lit(1)).alias("dropped")), s.exceptAll(v).distinct().agg(F.count(F.lit(1)).alias("strange")), s.groupBy("token").count().where("count > 1").agg(F.count(F.lit(1)).alias("doubled"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query("WITH w AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[^ -~]', '', 'g'), ' ?[A-Za-z]+')) AS piece FROM documents) SELECT piece, count(*) AS n FROM w GROUP BY piece")
def pretoken_counts(spark, sf_dir):
    plain = F.regexp_replace("text", "[^ -~]", "")
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(plain, F.lit(" ?[A-Za-z]+"), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS piece FROM documents), c AS (SELECT piece, count(*) AS n FROM w GROUP BY piece), h AS (SELECT n, regexp_extract_all(hex(encode(piece)), '..') AS h FROM c), p AS (SELECT n, h[i] AS l, h[i + 1] AS r FROM (SELECT n, h, unnest(range(1, len(h))) AS i FROM h)) SELECT l AS \"left\", r AS \"right\", sum(n)::BIGINT AS n FROM p GROUP BY 1, 2")
def pair_counts(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.pair_counts(pieces)


@query()
def pretoken_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = text.pretokens(F.col("text"))
    return d.select("doc_id", F.size(p).alias("n_pieces"), (F.array_join(p, "") == F.col("text")).alias("lossless"))


@query()
def bpe_train(spark, sf_dir):
    _, made = vocabulary.train_on(table(spark, sf_dir, "documents"), 600)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(made)], "rank int, left string, right string")


@query()
def bpe_encode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", vocabulary.encoder(*vocabulary.train_on(d, 600))("text").alias("ids")).select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


@query()
def bpe_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = vocabulary.train_on(d, 600)
    ids = d.select("doc_id", "text", vocabulary.encoder(*made)("text").alias("ids"))
    return ids.select("doc_id", (vocabulary.decoder(made[0])("ids") == F.col("text")).alias("same"))


@query()
def vocab_select(spark, sf_dir):
    """Greedy selection of 200 tokens with their closures; the vocabulary stays on the executors."""
    v = stored(spark, sf_dir)
    chosen, found = vocabulary.select_spread(v, merges_of(v), 200)
    return spark.createDataFrame([(t, len(found[t])) for t in sorted(chosen)], "token string, closure_size int")


CONFIGS = "(VALUES ('dense-a', 81920, 4096, 4096, 35, 32, 8, 11008, 0, 0, 0, 0, true), ('dense-b', 32256, 4096, 4096, 27, 16, 4, 5632, 0, 0, 0, 0, true), ('dense-c', 65536, 2048, 1536, 20, 12, 4, 4096, 0, 0, 0, 0, true), ('moe-a', 32256, 4096, 3072, 24, 24, 8, NULL, 2, 16, 4, 1024, true), ('moe-b', 32256, 4096, 4096, 24, 32, 8, NULL, 2, 24, 8, 1024, true))"
COLUMNS = "name, vocab, block, n_embd, n_layers, n_heads, n_kv_heads, ffn, n_shared, n_routed, topk, expert_hidden, tied"
SIZES = f"WITH k AS (SELECT * FROM {CONFIGS} t({COLUMNS})), c AS (SELECT name, tied, vocab::BIGINT AS vocab, block::BIGINT AS block, n_embd::BIGINT AS d, n_layers::BIGINT AS l, n_heads::BIGINT AS h, n_kv_heads::BIGINT AS kv, ffn::BIGINT AS ffn, n_shared::BIGINT AS ns, n_routed::BIGINT AS nr, topk::BIGINT AS tk, expert_hidden::BIGINT AS eh, n_embd // n_heads AS hd FROM k), z AS (SELECT *, 2 * d * h * hd + 2 * d * kv * hd + 2 * hd + 2 * d AS att, CASE WHEN ffn IS NULL THEN 3 * d * ((ns * eh + 255) // 256 * 256) + d * nr + nr * 3 * d * eh ELSE 3 * d * ((ffn + 255) // 256 * 256) END AS f_all, CASE WHEN ffn IS NULL THEN 3 * d * ((ns * eh + 255) // 256 * 256) + d * nr + tk * 3 * d * eh ELSE 3 * d * ((ffn + 255) // 256 * 256) END AS f_act FROM c)"


def configs(spark):
    t = spark.sql(f"SELECT * FROM VALUES {CONFIGS[8:-1]} AS t({COLUMNS})")
    return t.select(*[F.col(f.name).cast("long") if f.dataType.typeName() == "integer" else F.col(f.name) for f in t.schema.fields])


@query(SIZES + " SELECT name, vocab * d + d + l * (att + f_all) AS total_params, vocab * d + d + l * (att + f_act) AS active_params FROM z")
def param_count(spark, sf_dir):
    return runs.parameters(configs(spark))


@query(SIZES + " SELECT name, 6 * l * (att + f_act) + 12 * l * h * hd * block AS flops_per_token FROM z")
def flops(spark, sf_dir):
    return runs.flops(configs(spark))


@query("SELECT s::INT AS step, round(CASE WHEN s < 1000 THEN 6e-4 * s / 1000 WHEN s <= 34200 THEN 6e-4 ELSE 6e-5 + (6e-4 - 6e-5) * ((38000 - s) / 3800.0::DOUBLE) END, 12) AS lr FROM range(1, 38001, 37) t(s)")
def lr_wsd(spark, sf_dir):
    s = spark.range(1, 38001, 37).select(F.col("id").cast("int").alias("step"))
    return s.select("step", F.round(numeric.lr_stable_then_down(F.col("step"), 38000, 1000, 0.1, 6e-4, 6e-5), 12).alias("lr"))


@query("SELECT s::INT AS step, round(CASE WHEN s < 100 THEN 6e-4 * s / 100 WHEN s > 1000 THEN 1e-4 ELSE 1e-4 + 0.5::DOUBLE * (1 + cos(pi() * (s - 100) / 900.0::DOUBLE)) * (6e-4 - 1e-4) END, 10) AS lr FROM range(1, 1100) t(s)")
def lr_cosine_pre(spark, sf_dir):
    s = spark.range(1, 1100).select(F.col("id").cast("int").alias("step"))
    return s.select("step", F.round(numeric.lr_cosine(F.col("step"), 1000, 100, 6e-4, 1e-4), 10).alias("lr"))


@query("SELECT s::INT AS step, round(CASE WHEN s < 100 THEN 5e-5 * (s + 1) / 100 WHEN s >= 5000 THEN 5e-6 ELSE 5e-6 + 0.5::DOUBLE * (1 + cos(pi() * (s - 100) / 4900.0::DOUBLE)) * (5e-5 - 5e-6) END, 11) AS lr FROM range(0, 5100, 3) t(s)")
def lr_cosine_sft(spark, sf_dir):
    s = spark.range(0, 5100, 3).select(F.col("id").cast("int").alias("step"))
    return s.select("step", F.round(numeric.lr_cosine(F.col("step"), 5000, 100, 5e-5, 5e-6, from_zero=True), 11).alias("lr"))


@query("SELECT event_id, round(value / (ln(2) * 4.7177::DOUBLE), 6) AS bpb FROM events")
def bits_per_byte(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(numeric.bits_per_byte(F.col("value"), F.lit(4.7177)), 6).alias("bpb"))


@query("SELECT event_type, count(*) AS steps, round(4096 * 8 * 4 * count(*) / greatest(sum(user_id % 7 + 1), 1), 4) AS tokens_per_sec FROM events GROUP BY event_type")
def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.round(4096 * 8 * 4 * F.count(F.lit(1)) / F.greatest(F.sum(F.col("user_id") % 7 + 1), F.lit(1)), 4).alias("tokens_per_sec"))


@query("WITH l AS (SELECT event_type AS run, event_id AS step, value AS loss, least(100.0::DOUBLE, coalesce(min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100.0)) AS best FROM events) SELECT run, step, loss, best, loss < best AS is_best FROM l")
def best_so_far(spark, sf_dir):
    return runs.best_so_far(table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss")))


@query("SELECT s AS step FROM range(3800, 38001, 3800) t(s) WHERE s >= 25346 OR s = (SELECT max(s) FROM range(3800, 38001, 3800) u(s) WHERE s < 25346)")
def retention(spark, sf_dir):
    return runs.retained(spark.range(3800, 38001, 3800).withColumnRenamed("id", "step"), round(0.667 * 38000))


@query("SELECT 'run/step_' || max(i * 10)::VARCHAR AS path, max(i * 10)::BIGINT AS step FROM range(1, 50) t(i) WHERE i % 3 <> 0")
def latest_checkpoint(spark, sf_dir):
    i = F.col("id")
    paths = spark.range(1, 50).select(F.concat(F.lit("run/step_"), (i * 10).cast("string")).alias("path"), (i % 3 != 0).alias("complete")).union(spark.sql("SELECT 'run/best_val', true"))
    return runs.latest_complete(paths)


@query("SELECT i::INT AS layer, i % 5 = 4 AS global_end, i % 5 = 0 OR i = 34 AS global_start FROM range(35) t(i)")
def layer_kinds(spark, sf_dir):
    i = F.col("id")
    return spark.range(35).select(i.cast("int").alias("layer"), runs.global_layer(i, 35, 5, "end").alias("global_end"), runs.global_layer(i, 35, 5, "start").alias("global_start"))


@query("WITH g AS (SELECT p AS pos, i::INT AS pair, CASE WHEN i < 4 THEN p / pow(10000.0::DOUBLE, 2.0::DOUBLE * i / 32) ELSE 0 END AS a FROM range(128) t(p), range(16) u(i)) SELECT pos, pair, round(sin(a), 9) AS sin, round(cos(a), 9) AS cos FROM g")
def rope_table(spark, sf_dir):
    return runs.rotary(spark, 128, 32, share=0.25).select("pos", "pair", F.round("sin", 9).alias("sin"), F.round("cos", 9).alias("cos"))


@query("SELECT 1599::BIGINT AS train_shards, 1::BIGINT AS val_shards, (1599 * ((99999744 - 1) // 131072))::BIGINT AS microsteps, (1599 * ((99999744 - 1) // 131072)) // 32::BIGINT AS steps_available, true AS enough, 38000::BIGINT * 32 * 131072 AS tokens, round(38000::BIGINT * 32 * 131072 / 6538171136::DOUBLE, 2) AS tokens_per_parameter, 34200::BIGINT AS down_from")
def preflight(spark, sf_dir):
    shards = spark.range(1600).select(F.when(F.col("id") < 1, "val").otherwise("train").alias("split"), F.lit(99_999_744).cast("long").alias("n_tokens"))
    return runs.preflight(shards, group=131_072, accumulation=32, steps=38_000, down_ratio=0.1, parameters=6_538_171_136)
