"""Queries: corpus statistics, sampling, instruction tuning, multiple choice, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import arrays, numeric, text
from corpusforge.operators import choices, routing, sft, stats
from corpusforge.plans.base import query, table

HEX = "regexp_extract_all(hex(encode({0})), '..')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


HIST = f"p AS (SELECT unnest({HEX.format('text')}) AS p FROM documents), h AS (SELECT ('0x' || p)::INT AS token_id, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 256, count(*) FROM documents)"


@query(f"WITH {HIST} SELECT token_id, n FROM h")
def token_histogram(spark, sf_dir):
    return stats.token_histogram(docs(spark, sf_dir))


@query(f"WITH {HIST} SELECT count(*) AS distinct_tokens, sum(n)::BIGINT AS tokens FROM h WHERE n > 0")
def distinct_tokens(spark, sf_dir):
    return stats.token_histogram(docs(spark, sf_dir)).agg(F.count_distinct("token_id").alias("distinct_tokens"), F.sum("n").alias("tokens"))


@query("SELECT count(*) AS documents, sum(strlen(text) + 1)::BIGINT AS byte_tokens, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS word_tokens, sum(strlen(text))::BIGINT AS utf8_bytes FROM documents")
def corpus_totals(spark, sf_dir):
    return stats.totals(docs(spark, sf_dir))


@query("SELECT lang, round(sum(strlen(text)) / greatest(sum(len(regexp_extract_all(text, '\\S+'))), 1), 6) AS bytes_per_word, round(sum(strlen(text) + 1) / greatest(sum(len(regexp_extract_all(text, '\\S+'))), 1), 6) AS token_ratio FROM documents GROUP BY lang")
def compression_ratio(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", F.octet_length("text").alias("b"), F.regexp_count("text", F.lit(r"\S+")).alias("w"))
    words = F.greatest(F.sum("w"), F.lit(1))
    return d.groupBy("lang").agg(F.round(F.sum("b") / words, 6).alias("bytes_per_word"), F.round(F.sum(F.col("b") + 1) / words, 6).alias("token_ratio"))


@query("WITH p AS (SELECT doc_id // 100 AS win, sum(strlen(text) + 1) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM documents), q AS (SELECT win, coalesce(pos, 0)::BIGINT AS pos FROM p), n AS (SELECT *, lead(pos) OVER (PARTITION BY win ORDER BY pos) AS nxt FROM q) SELECT win AS window, pos + 1 AS start, nxt - pos - 1 AS n FROM n WHERE nxt IS NOT NULL AND nxt - pos - 1 BETWEEN 8 AND 100000")
def span_extract(spark, sf_dir):
    from pyspark.sql import Window as W

    by = W.partitionBy("window").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    d = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 100).alias("window"), "doc_id", (F.octet_length("text") + 1).alias("n"))
    return stats.spans(d.select("window", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("pos")))


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7' || doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 5")
def stratified_sample(spark, sf_dir):
    return stats.stratified(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 5, "7").select("source", "doc_id")


@query("SELECT i::INT AS part, (1000 // 7 + CASE WHEN i < 1000 % 7 THEN 1 ELSE 0 END)::BIGINT AS share FROM range(7) t(i)")
def quota(spark, sf_dir):
    return spark.range(7).select(F.col("id").cast("int").alias("part"), stats.quota(1000, F.col("id"), 7).alias("share"))


@query("SELECT doc_id, ('0x' || left(md5('w' || doc_id::VARCHAR), 6))::INT % greatest(strlen(text) - 64 + 1, 1) AS start FROM documents")
def window_starts(spark, sf_dir):
    h = F.conv(F.substring(stats.hash_order("w", F.col("doc_id")), 1, 6), 16, 10).cast("long")
    return docs(spark, sf_dir).select("doc_id", F.pmod(h, F.greatest(F.octet_length("text") - 64 + 1, F.lit(1)).cast("long")).alias("start"))


@query("SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i % greatest(n // 64, 1) = 0")
def strided_sample(spark, sf_dir):
    from corpusforge.operators import packing

    ranked = packing.with_offsets(docs(spark, sf_dir).select("doc_id", "n_chars", F.lit(1).cast("long").alias("one")), value="one", out="i")
    n = ranked.agg(F.count(F.lit(1)).alias("total"))
    return ranked.crossJoin(F.broadcast(n)).where(F.col("i") % F.greatest(F.floor(F.col("total") / 64), F.lit(1)) == 0).select("doc_id", "n_chars")


@query("SELECT min(n) AS n_min, max(n) AS n_max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS iqr FROM (SELECT strlen(text)::BIGINT + 2 AS n FROM documents)")
def length_stats(spark, sf_dir):
    return docs(spark, sf_dir).select((F.octet_length("text") + 2).alias("n")).agg(*stats.length_statistics(F.col("n")))


@query("SELECT t AS threshold, count(*) FILTER (WHERE n > t) AS above, round(100.0::DOUBLE * count(*) FILTER (WHERE n > t) / count(*), 6) AS percent FROM (SELECT strlen(text) + 2 AS n FROM documents), (SELECT unnest([1024, 2048, 4096]) AS t) GROUP BY t")
def length_thresholds(spark, sf_dir):
    n = docs(spark, sf_dir).select((F.octet_length("text") + 2).alias("n"), F.explode(F.array(F.lit(1024), F.lit(2048), F.lit(4096))).alias("threshold"))
    above = F.count_if(F.col("n") > F.col("threshold"))
    return n.groupBy("threshold").agg(above.alias("above"), F.round(100.0 * above / F.count(F.lit(1)), 6).alias("percent"))


PAIRS = "WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, turn, text AS instruction, response FROM n WHERE role = 'user' AND nr = 'assistant'), u AS (SELECT * FROM p WHERE coalesce(instruction, '') <> '' AND coalesce(response, '') <> '')"
EX = PAIRS + ", x AS (SELECT *, 'User: ' || instruction || chr(10) || 'Assistant: ' || response AS rendered FROM u), e AS (SELECT *, strlen(rendered)::BIGINT AS n_tokens, strlen('User: ' || instruction || chr(10) || 'Assistant: ')::BIGINT AS mask_len FROM x WHERE strlen(rendered) <= 2048)"


def pairs(spark, sf_dir):
    return sft.usable(sft.pairs(table(spark, sf_dir, "conversations")))


@query(PAIRS + " SELECT conv_id, turn, instruction, response FROM p")
def sft_pairs(spark, sf_dir):
    return sft.pairs(table(spark, sf_dir, "conversations"))


@query(PAIRS + " SELECT conv_id, turn FROM u")
def sft_filter(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn")


@query(EX + " SELECT conv_id, turn, rendered, n_tokens FROM e")
def sft_template(spark, sf_dir):
    return sft.examples(pairs(spark, sf_dir)).select("conv_id", "turn", "rendered", "n_tokens")


@query(EX + ", m AS (SELECT *, greatest(least(n_tokens, 256) - 1, 0) AS l FROM e) SELECT conv_id, turn, greatest(0, least(l, mask_len - 1)) AS first, l - greatest(0, least(l, mask_len - 1)) AS counted FROM m")
def sft_mask(spark, sf_dir):
    counted, first = sft.mask_counts(F.col("n_tokens"), F.col("mask_len"), 256)
    return sft.examples(pairs(spark, sf_dir)).select("conv_id", "turn", first.alias("first"), counted.alias("counted"))


@query(EX + ", r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42' || conv_id::VARCHAR || '-' || turn::VARCHAR), conv_id, turn) - 1 AS rn, count(*) OVER () AS n FROM e) SELECT conv_id, turn, CASE WHEN rn < floor(n * 0.95::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r")
def sft_split(spark, sf_dir):
    ex = sft.examples(pairs(spark, sf_dir)).withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return stats.split_by_hash(ex.select("conv_id", "turn", "key"), "key", "42").select("conv_id", "turn", "split")


BATCH = EX + ", r AS (SELECT *, row_number() OVER (ORDER BY md5('7' || conv_id::VARCHAR || '-' || turn::VARCHAR), conv_id, turn) - 1 AS rn FROM e), b AS (SELECT *, rn // 8 AS batch, (rn % 8)::INT AS place FROM r), w AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch) AS width FROM b)"


@query(BATCH + " SELECT conv_id, turn, batch, place, width FROM w")
def sft_batches(spark, sf_dir):
    return sft.batches(sft.examples(pairs(spark, sf_dir)), 8, "7").select("conv_id", "turn", "batch", "place", "width")


@query(BATCH + " SELECT conv_id, turn, n_tokens, width - n_tokens AS padding, md5(hex(encode(rendered)) || repeat('00', (width - n_tokens)::INT)) AS padded FROM w")
def sft_pad(spark, sf_dir):
    b = sft.batches(sft.examples(pairs(spark, sf_dir)), 8, "7")
    pad = F.col("width") - F.col("n_tokens")
    return b.select("conv_id", "turn", "n_tokens", pad.alias("padding"), F.md5(F.concat(F.hex(F.encode("rendered", "UTF-8")), F.expr("repeat('00', cast(width - n_tokens as int))"))).alias("padded"))


@query(EX + " SELECT conv_id, round(sum(n_tokens * (mask_len % 3)) / greatest(sum(mask_len % 3), 1), 6) AS loss FROM e GROUP BY conv_id")
def masked_loss(spark, sf_dir):
    e = sft.examples(pairs(spark, sf_dir))
    return e.groupBy("conv_id").agg(F.round(sft.masked_mean(F.col("n_tokens"), F.col("mask_len") % 3), 6).alias("loss"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'Assistant:') THEN text ELSE regexp_replace(text, '\\s+$', '') || chr(10) || 'Assistant: ' END AS prompt FROM conversations WHERE role = 'user'")
def prompt_cue(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.with_answer_cue(F.col("text")).alias("prompt"))


# Items: the first half of a benchmark text as context, four endings from it and its neighbours, the own one at id mod 4.
ITEMS = "WITH i AS (SELECT item_id AS item, left(text, length(text) // 2) AS context, substr(text, length(text) // 2 + 1, 40) AS own FROM benchmark), t AS (SELECT item, context, own, coalesce(lead(own, 1) OVER (ORDER BY item), 'a') AS x1, coalesce(lead(own, 2) OVER (ORDER BY item), 'b') AS x2, coalesce(lead(own, 3) OVER (ORDER BY item), 'c') AS x3 FROM i), m AS (SELECT item, context, (item % 4)::INT AS label, CASE item % 4 WHEN 0 THEN [own, x1, x2, x3] WHEN 1 THEN [x1, own, x2, x3] WHEN 2 THEN [x1, x2, own, x3] ELSE [x1, x2, x3, own] END AS choices FROM t), r AS (SELECT item, label, context, c - 1 AS choice, ' ' || choices[c] AS ending FROM m, range(1, 5) g(c))"


def items(spark, sf_dir):
    from pyspark.sql import Window as W

    half = F.floor(F.char_length("text") / 2).cast("int")
    i = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.substring("text", F.lit(1), half).alias("context"), F.substring("text", half + 1, F.lit(40)).alias("own"))
    by = W.orderBy("item")
    t = i.select("*", *[F.coalesce(F.lead("own", k).over(by), F.lit(x)).alias(f"x{k}") for k, x in ((1, "a"), (2, "b"), (3, "c"))])
    place = (F.col("item") % 4).cast("int")
    lists = [F.array("own", "x1", "x2", "x3"), F.array("x1", "own", "x2", "x3"), F.array("x1", "x2", "own", "x3"), F.array("x1", "x2", "x3", "own")]
    return t.select("item", "context", place.alias("label"), F.when(place == 0, lists[0]).when(place == 1, lists[1]).when(place == 2, lists[2]).otherwise(lists[3]).alias("choices"))


@query(ITEMS + " SELECT item, choice::INT AS choice, ending, strlen(context)::BIGINT AS n_context, strlen(ending)::BIGINT AS n_ending FROM r")
def mc_render(spark, sf_dir):
    return choices.render(items(spark, sf_dir)).select("item", "choice", "ending", "n_context", "n_ending")


SCORED = ITEMS + f", {HIST}, l AS (SELECT b::INT AS byte, -ln((coalesce(h.n, 0) + 1) / ((SELECT sum(n) FROM h WHERE token_id < 256) + 256)) AS loss FROM range(256) t(b) LEFT JOIN h ON h.token_id = b), z AS (SELECT item, label, choice, ('0x' || unnest({HEX.format('ending')}))::INT AS byte FROM r), s AS (SELECT item, label, choice::INT AS choice, round(avg(l.loss), 9) AS loss FROM z JOIN l USING (byte) GROUP BY ALL), w AS (SELECT item, label, (arg_min(choice, loss * 1e6 + choice * 1e-6))::INT AS predicted FROM s GROUP BY item, label)"


def scored(spark, sf_dir):
    return choices.score(choices.render(items(spark, sf_dir)), choices.byte_losses(docs(spark, sf_dir)))


@query(SCORED + " SELECT item, choice, round(loss, 6) AS loss FROM s")
def mc_score(spark, sf_dir):
    return scored(spark, sf_dir).select("item", "choice", F.round("loss", 6).alias("loss"))


JUDGED = SCORED + ", j AS (SELECT item, CASE item % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS task, CASE WHEN item % 3 = 2 THEN NULL ELSE predicted = label END AS correct FROM w), acc AS (SELECT task, count(correct) AS n, CASE WHEN count(correct) > 0 THEN round(sum(correct::INT) / count(correct), 6) END AS accuracy FROM j GROUP BY task)"


def judged(spark, sf_dir):
    best = choices.best(scored(spark, sf_dir)).join(items(spark, sf_dir).select("item", "label"), "item")
    third = F.col("item") % 3
    return best.select("item", F.when(third == 0, "first").when(third == 1, "second").otherwise("third").alias("task"), F.when(third != 2, F.col("predicted") == F.col("label")).alias("correct"))


@query(SCORED + " SELECT item, predicted FROM w")
def mc_predict(spark, sf_dir):
    return choices.best(scored(spark, sf_dir))


@query(JUDGED + " SELECT task, n, accuracy FROM acc")
def mc_accuracy(spark, sf_dir):
    return choices.accuracy(judged(spark, sf_dir))


@query(JUDGED + " SELECT round(avg(accuracy), 6) AS core, count(accuracy) AS tasks FROM acc")
def mc_core(spark, sf_dir):
    return choices.accuracy(judged(spark, sf_dir)).agg(F.round(F.avg("accuracy"), 6).alias("core"), F.count("accuracy").alias("tasks"))


@query("SELECT item_id AS item, (i % 3)::INT AS rank FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) WHERE i < n // 3 * 3 AND i < 1000")
def mc_rank_shard(spark, sf_dir):
    from pyspark.sql import Window as W

    i = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), (F.row_number().over(W.orderBy("item_id")) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    return i.where((F.col("i") < F.floor(F.col("n") / 3) * 3) & (F.col("i") < 1000)).select("item", F.pmod("i", F.lit(3)).cast("int").alias("rank"))


@query("SELECT item_id AS item, text AS context, (item_id % 5)::INT AS label FROM benchmark WHERE item_id % 5 < 4")
def mc_repair(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    raw = b.select(F.col("item_id").alias("item"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("question"), F.when(F.col("item_id") % 2 == 1, F.col("text")).alias("question_stem"), F.array(*[F.lit(x) for x in "wxyz"]).alias("choices"), F.array(*[F.lit(x) for x in "ABCD"]).alias("labels"), F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("item_id") % 5 + 1).cast("int")).alias("answer_key"))
    return choices.repaired(raw).select("item", "context", "label")


N_EXPERTS = 8
GATE = "WITH l AS (SELECT vec_id, e::INT AS expert, list_sum([x::DOUBLE for x, i in embedding if (i - 1) % 8 = e]) AS logit FROM embeddings, range(8) t(e)), g AS (SELECT vec_id, expert, round(1 / (1 + exp(-coalesce(logit, 0))), 6) AS score FROM l), b AS (SELECT i::INT AS expert, round(0.001 * (i - 3), 6) AS bias FROM range(8) t(i)), k AS (SELECT g.vec_id, g.expert, g.score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score + bias::DOUBLE, 9) DESC, g.expert) AS place FROM g JOIN b USING (expert)), t AS (SELECT vec_id, place::INT AS place, expert, round(score / sum(score) OVER (PARTITION BY vec_id), 6) AS weight FROM k WHERE place <= 2)"


def routed(spark, sf_dir):
    bias = spark.range(N_EXPERTS).select(F.col("id").cast("int").alias("expert"), F.round(0.001 * (F.col("id") - 3), 6).alias("bias"))
    return routing.top_k(routing.gate(table(spark, sf_dir, "embeddings"), N_EXPERTS), bias, 2)


@query(GATE + " SELECT vec_id, place, expert, weight FROM t")
def expert_topk(spark, sf_dir):
    return routed(spark, sf_dir)


LOAD = GATE + ", n AS (SELECT e::INT AS expert, (SELECT count(*) FROM t WHERE t.expert = e) AS n FROM range(8) r(e))"


@query(LOAD + " SELECT expert, n FROM n")
def expert_load(spark, sf_dir):
    return routing.load(routed(spark, sf_dir), N_EXPERTS)


@query(LOAD + " SELECT expert, 0.001::DOUBLE * sign(0.125::DOUBLE - n / (SELECT sum(n) FROM n)) AS step FROM n")
def expert_bias(spark, sf_dir):
    return routing.balance(routing.load(routed(spark, sf_dir), N_EXPERTS), N_EXPERTS)


@query(GATE + " SELECT vec_id, round(sum(weight * (expert + 1) * 0.5::DOUBLE), 7) AS total FROM t GROUP BY vec_id")
def expert_combine(spark, sf_dir):
    values = spark.range(N_EXPERTS).select(F.col("id").cast("int").alias("expert"), ((F.col("id") + 1) * 0.5).alias("value"))
    return routing.combine(routed(spark, sf_dir), values)


@query(GATE + " SELECT vec_id, expert, (expert // 4)::INT AS owner, (expert % 4)::INT AS slot FROM t")
def expert_dispatch(spark, sf_dir):
    return routed(spark, sf_dir).select("vec_id", "expert", F.floor(F.col("expert") / 4).cast("int").alias("owner"), (F.col("expert") % 4).alias("slot"))


@query("SELECT q, k FROM range(200) a(q), range(200) b(k) WHERE k <= q AND q - k < 16")
def window_mask_pairs(spark, sf_dir):
    return routing.window_pairs(200, 16, spark)


@query("WITH g AS (SELECT vec_id, i - 1 AS dim, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS place FROM g) SELECT vec_id, dim::INT AS dim, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS p FROM r WHERE place <= 10")
def topk_sample_support(spark, sf_dir):
    from pyspark.sql import Window as W

    g = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    kept = g.withColumn("place", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("x"), "dim"))).where("place <= 10")
    return kept.select("vec_id", "dim", F.round(F.exp("x") / F.sum(F.exp("x")).over(W.partitionBy("vec_id")), 6).alias("p"))


@query("SELECT vec_id, round(30 * tanh(list_sum([x::DOUBLE for x in embedding]) / 30), 5) AS capped FROM embeddings")
def soft_cap(spark, sf_dir):
    from corpusforge.functions.numeric import soft_cap as cap

    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", numeric.rounded(cap(total), 5).alias("capped"))


@query("SELECT vec_id, round(list_sum([x::DOUBLE for x, i in embedding if i <= len(embedding) // 2]), 4) AS left_sum, round(list_sum([x::DOUBLE for x, i in embedding if i > len(embedding) // 2]), 4) AS right_sum FROM embeddings")
def array_halves(spark, sf_dir):
    a, b = arrays.halves(F.col("embedding"))
    total = lambda x: numeric.rounded(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")), 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(a).alias("left_sum"), total(b).alias("right_sum"))
