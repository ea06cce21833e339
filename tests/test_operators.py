"""Operators against small sequential models and worked examples."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import arrays, numeric, text
from corpusforge.operators import audit, batches, choices, packing, runs, sft, stats, vocabulary


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_blocks_against_a_buffer(spark):
    docs = [(5, "abc"), (1, "défg" * 7), (9, ""), (70_000, None), (200_000, "tail end")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    stream = [t for _, s in sorted(docs) for t in [256, *(s or "").encode()]]
    for block in (4, 7, 100):
        want = {i // block: stream[i : i + block] for i in range(0, len(stream), block)}
        full = {k: v for k, v in want.items() if len(v) == block}
        rows = packing.blocks(df, block).select("block", packing.decode(F.col("stream")).alias("t")).collect()
        assert {r.block: r.t for r in rows} == full
        tail = packing.blocks(df, block, keep_tail=True).select("block", packing.decode(F.col("stream")).alias("t")).collect()
        assert {r.block: r.t for r in tail} == want
        later = packing.blocks(df, block, first_block=2).collect()
        assert {r.block for r in later} == {k for k in full if k >= 2}


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.blocks(none, 8).count() == 0


def test_resume_positions(spark):
    df = spark.createDataFrame([(0, "abcd"), (1, "ef"), (2, "01234567"), (3, "")], "doc_id long, text string")
    got = {r.shard: (r.completed_docs, r.doc_token_offset) for r in packing.shard_positions(df, 8).collect()}
    assert got == {0: (2, 0), 1: (2, 8)}


def test_seek_and_positions(spark):
    shards = spark.createDataFrame([(0, 9), (1, 9), (2, 0)], "shard long, n_tokens long")
    steps = batches.shard_steps(shards, 4)
    assert [(r.shard, r.steps, r.before) for r in steps.orderBy("shard").collect()] == [(0, 2, 0), (1, 2, 2), (2, 0, 4)]
    wanted = spark.createDataFrame([(2,), (5,)], "step long")
    assert {(r.step, r.shard, r.microstep) for r in batches.seek(steps, wanted, 1).collect()} == {(2, 1, 0), (5, 0, 1)}
    windows = {(r.shard, r.microstep, r.rank): (r.start, r.stop) for r in batches.rank_windows(steps, 1, 2, 2).collect()}
    assert windows[0, 1, 1] == (6, 9) and len(windows) == 8


@pytest.mark.parametrize(("n", "k", "want"), [(10, 3, [0, 4, 9]), (1599, 3, [0, 799, 1598]), (2, 5, [0, 1]), (7, 1, [0])])
def test_evenly_spaced(spark, n, k, want):
    assert column(spark, audit.evenly_spaced(F.lit(n), k)) == want


def test_metadata_mismatch(spark):
    a = spark.createDataFrame([("block_size", "4"), ("dtype", "uint16"), ("x", None)], "key string, value string")
    b = spark.createDataFrame([("block_size", "8"), ("dtype", "uint16"), ("x", None)], "key string, value string")
    assert [tuple(r) for r in audit.mismatches(a, b).collect()] == [("block_size", "4", "8")]


def test_schedules(spark):
    at = lambda f, s: column(spark, f(F.lit(s)))
    stable = lambda s: numeric.lr_stable_then_down(s, 38000, 1000, 0.1, 6e-4, 6e-5)
    for step, want in ((1, 6e-7), (500, 3e-4), (1000, 6e-4), (34200, 6e-4), (36100, 3.3e-4), (38000, 6e-5)):
        assert at(stable, step) == pytest.approx(want)
    pre = lambda s: numeric.lr_cosine(s, 1000, 100, 6e-4, 1e-4)
    for step, want in ((50, 3e-4), (100, 6e-4), (550, 3.5e-4), (1000, 1e-4), (1001, 1e-4)):
        assert at(pre, step) == pytest.approx(want)
    tune = lambda s: numeric.lr_cosine(s, 5000, 100, 5e-5, 5e-6, from_zero=True)
    for step, want in ((0, 5e-7), (99, 5e-5), (100, 5e-5), (2550, 2.75e-5), (5000, 5e-6)):
        assert at(tune, step) == pytest.approx(want)


def test_dtype_errors(spark):
    assert column(spark, numeric.id_dtype(F.lit(65536))) == "uint16"
    for bad in (0, (1 << 32) + 1):
        with pytest.raises(Exception, match="ids beyond|needs an id"):
            column(spark, numeric.id_dtype(F.lit(bad)))


def test_arrays(spark):
    x = F.array(*[F.lit(i) for i in (3, 1, 4, 1, 5, 9)])
    assert column(spark, arrays.positions_of(x, 1)) == [1, 3]
    assert column(spark, arrays.pad_right(x, 8, 0)) == [3, 1, 4, 1, 5, 9, 0, 0]
    assert column(spark, arrays.pad_right(x, 2, 0)) == [3, 1]
    assert column(spark, arrays.loss_mask(F.lit(5), F.lit(3))) == [False, False, True, True, True]
    assert column(spark, arrays.loss_mask(F.lit(2), F.lit(0))) == [True, True]
    assert column(spark, arrays.loss_mask(F.lit(0), F.lit(0))) == []
    a, b = arrays.shifted(x)
    assert column(spark, a) == [3, 1, 4, 1, 5] and column(spark, b) == [1, 4, 1, 5, 9]
    assert column(spark, arrays.rows_of(x, 2, 3)) == [[3, 1, 4], [1, 5, 9]]
    assert column(spark, arrays.sandwich(x, 0))[::7] == [0, 0]
    one, zero = F.array(*[F.lit(1.0)] * 4), F.array(*[F.lit(0.0)] * 4)
    v = F.array(*[F.lit(float(i)) for i in range(4)])
    assert column(spark, arrays.rotate(v, zero, one)) == [0, 1, 2, 3]
    assert column(spark, arrays.rotate(v, one, zero)) == [-2, -3, 0, 1]


def test_pretokens(spark):
    for s, want in (("a  b", ["a", " ", " b"]), ("1234567", ["123", "456", "7"]), ("tab\t\tq", ["tab", "\t", "\tq"]), ("a\r\n\r\n b", None)):
        got = column(spark, text.pretokens(F.lit(s)))
        assert "".join(got) == s
        if want:
            assert got == want


def test_prompt_cue(spark):
    assert column(spark, text.with_answer_cue(F.lit("hi  \n"))) == "hi\nAssistant: "
    assert column(spark, text.with_answer_cue(F.lit("User: a\nAssistant: b "))) == "User: a\nAssistant: b "


def reference_training(counts, size, min_count=2):
    """The same rules without any index: recount all pairs each round."""
    alphabet = vocabulary.byte_alphabet()
    names = sorted(alphabet.values())
    ids = {c: i for i, c in enumerate(names)}
    words, merges = [([ids[alphabet[b]] for b in p.encode()], n) for p, n in counts], []
    while len(names) < size:
        total = {}
        for w, n in words:
            for pair in zip(w, w[1:]):
                total[pair] = total.get(pair, 0) + n
        if not total or max(total.values()) < min_count:
            break
        best = min(total, key=lambda p: (-total[p], p))
        merges.append((names[best[0]], names[best[1]]))
        names.append(names[best[0]] + names[best[1]])
        out = []
        for w, n in words:
            i, new = 0, []
            while i < len(w):
                if tuple(w[i : i + 2]) == best:
                    new.append(len(names) - 1)
                    i += 2
                else:
                    new.append(w[i])
                    i += 1
            out.append((new, n))
        words = out
    return merges


def test_byte_pairs():
    counts = [(" the", 30), ("the", 9), (" them", 7), ("aaaa", 5), (" banana", 4), ("naïve", 3), ("x", 2)]
    vocab, merges = vocabulary.train(counts, 290)
    assert merges == reference_training(counts, 290)
    assert len(vocab) == 256 + len(merges)


def test_encode_round_trip(spark):
    docs = spark.createDataFrame([(1, "the banana the"), (2, "naïve café"), (3, "")], "doc_id long, text string")
    vocab, merges = vocabulary.train([("the", 9), (" banana", 5)], 270)
    ids = docs.select("text", vocabulary.encoder(vocab, merges)("text").alias("ids"))
    for r in ids.select("text", "ids", vocabulary.decoder(vocab)("ids").alias("back")).collect():
        assert r.back == r.text


def test_closure_and_selection():
    merges = [(0, "a", "b"), (1, "ab", "c"), (2, "b", "c"), (3, "a", "bc")]
    found = vocabulary.closures(merges, {"a", "b", "c", "ab", "bc", "abc"}, {"a", "b", "c"})
    assert found["abc"] == {"a", "b", "c", "ab", "abc"}
    assert vocabulary.select(["abc", "bc", "ab"], found, {"a", "b", "c"}, 5) == {"a", "b", "c", "ab", "abc"}
    assert vocabulary.select(["abc", "bc", "ab"], found, {"a", "b", "c"}, 4) == {"a", "b", "c", "bc"}
    with pytest.raises(ValueError, match="budget"):
        vocabulary.select([], found, {"abc"}, 4)
    with pytest.raises(ValueError, match="can't be built"):
        vocabulary.select([], found, {"zz"}, 4)


def test_reachable_whatever_the_rank(spark):
    atoms = spark.createDataFrame([("a",)], "token string")
    merges = spark.createDataFrame([("aa", "a"), ("a", "a"), ("x", "a")], "left string, right string")
    assert {r.token for r in vocabulary.reachable(atoms, merges).collect()} == {"a", "aa", "aaa"}


def test_merge_violation(spark):
    merges = spark.createDataFrame([(0, "a", "missing")], "rank int, left string, right string")
    vocab = spark.createDataFrame([("a",), ("amissing",)], "token string")
    assert [(r["rank"], r.has_left, r.has_right, r.has_output) for r in vocabulary.violations(merges, vocab).collect()] == [(0, True, False, True)]


@pytest.mark.parametrize(("n", "cut"), [(20, 19), (99, 94), (100, 95), (399, 379), (1000, 950)])
def test_split(spark, n, cut):
    got = stats.split_by_hash(spark.range(n), "id", "42").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": cut, "val": n - cut}


def test_spans(spark):
    at = spark.createDataFrame([(0, 0), (0, 9), (0, 17)], "window long, pos long")
    assert [tuple(r) for r in stats.spans(at).collect()] == [(0, 1, 8)]


def test_pairs_and_filter(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "lost"), (2, 0, "user", ""), (2, 1, "assistant", "a"), (3, 0, "user", "q"), (3, 1, "assistant", None)]
    df = sft.pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert df.count() == 3
    assert [(r.conv_id, r.turn) for r in sft.usable(df).collect()] == [(1, 1)]


def test_choice_ties_and_missing_tasks(spark):
    scored = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, 1.0)], "item long, choice int, loss double")
    assert choices.best(scored).first()["predicted"] == 1
    judged = spark.createDataFrame([("a", True), ("a", False), ("b", None)], "task string, correct boolean")
    assert {r.task: (r.n, r.accuracy) for r in choices.accuracy(judged).collect()} == {"a": (2, 0.5), "b": (0, None)}


def test_retention_and_latest(spark):
    steps = spark.createDataFrame([(s,) for s in (10, 20, 30, 40)], "step long")
    assert {r.step for r in runs.retained(steps, 30).collect()} == {20, 30, 40}
    assert {r.step for r in runs.retained(steps, 0).collect()} == {10, 20, 30, 40}
    paths = spark.createDataFrame([("r/step_20", True), ("r/step_100", False), ("r/step_9/", True), ("r/best", True)], "path string, complete boolean")
    assert tuple(runs.latest_complete(paths).first()) == ("r/step_20", 20)


def test_accounting(spark):
    from corpusforge.plans.models import configs

    want = {"dense-a": (6538171136, 6538171136), "dense-b": (3133384192, 3133384192), "dense-c": (604047872, 604047872), "moe-a": (4781270016, 2063361024), "moe-b": (8993056768, 4161218560)}
    assert {r.name: (r.total_params, r.active_params) for r in runs.parameters(configs(spark)).collect()} == want
    assert {r.name: r.flops_per_token for r in runs.flops(configs(spark)).collect()} == {"dense-a": 44262167040, "dense-b": 23443375104, "dense-c": 3775272960, "moe-a": 15409483776, "moe-b": 29006401536}


def test_training_counts_pieces_that_occur_once(spark, monkeypatch):
    texts = ["xqa", "xqb", "xqc", "xqd", "ab", "ab"]  # x q stands in four pieces, each of which occurs once
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vocab, merges = vocabulary.train_on(docs, 257)
    assert merges == [("x", "q")]
    monkeypatch.setattr(vocabulary, "MAX_PIECES", 4)
    with pytest.raises(ValueError):
        vocabulary.train_on(docs, 257)


def test_rounding_keeps_the_sign_of_zero_as_the_sql_does(spark, tmp_path):
    import duckdb

    from corpusforge import plans

    vectors = [(0, [-1e-6, 1.0, 2.0, -4e-6]), (1, [1e-6, -0.5, -0.0, 0.0]), (2, [0.123456, None, 1.0, -2.5])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(repr(tuple(r)) for r in plans.QUERIES["array_gather"](spark, str(tmp_path)).collect())
    assert got == sorted(repr(r) for r in con.execute(plans.ORACLE["array_gather"]).fetchall()) and "-0.0" in got[0]
