import json
import random

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import pruning, vocabulary

SPECIALS = ("<pad>", "<eos>", "<bos>", "<unk>")
TEXT = "the cat and the hat sat on the mat; that bat and that cat ate the oat. Über naïve λ = 3.5\n\tdef f(x): return x"


@pytest.fixture(scope="module")
def source():
    """A byte-level model with specials in front, as a model file has it."""
    words = TEXT.split(" ")
    alphabet = vocabulary.byte_alphabet()
    vocab, merges = vocabulary.train([(w, 1 + i % 3) for i, w in enumerate(words)] + [(" " + w, 2) for w in words], 330)
    ids = {t: i for i, t in enumerate(SPECIALS)}
    ids |= {t: i + len(SPECIALS) for t, i in vocab.items()}
    assert set(alphabet.values()) <= set(vocab)
    return {
        "version": "1.0",
        "truncation": None,
        "padding": None,
        "added_tokens": [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(SPECIALS)],
        "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": ids, "merges": [list(m) for m in merges]},
    }


def counts(spark, source):
    rng = random.Random(2)
    return spark.createDataFrame([(i, rng.randint(1, 50)) for i in source["model"]["vocab"].values()], "id int, n long")


def test_pruned_model_encodes_and_decodes(spark, source):
    from tokenizers import Tokenizer

    budget = 300
    out = pruning.prune(spark, source, counts(spark, source), budget, leading=SPECIALS, custom=("<think>", "</think>"), keep=("the",) if "the" in source["model"]["vocab"] else ())
    assert {r["name"]: r.ok for r in out["checks"].collect()} == dict.fromkeys(["size", "dense_ids", "tokens_once", "specials_kept", "atoms_kept", "merges_closed", "mapping_exact", "leading_ids", "reachable"], True)
    model = out["model"]
    assert sorted(model["model"]["vocab"].values()) == list(range(budget))
    tok = Tokenizer.from_str(json.dumps(model))
    assert all(ok for _, ok in pruning.round_trips(model, [TEXT, "Hello  world!\n", "中文 العربية 🧠", "\x00\x01 "]))
    assert [tok.token_to_id(t) for t in SPECIALS] == [0, 1, 2, 3]
    for t in (*SPECIALS, "<think>", "</think>"):
        assert tok.encode(t, add_special_tokens=False).ids == [model["model"]["vocab"][t]]
    ids = tok.encode("hello", add_special_tokens=True).ids
    assert ids[0] == 2 and ids.count(2) == 1 and 2 not in tok.encode("hello", add_special_tokens=False).ids
    old = {i: t for t, i in source["model"]["vocab"].items()}
    for r in out["ids"].collect():
        assert r.old_id is None and r.token in ("<think>", "</think>") or old[r.old_id] == r.token
    back = {r.old_id: r.new_id for r in out["inverse"].collect()}
    assert len(back) == len(old) and sum(v >= 0 for v in back.values()) == budget - 2


def test_budget_must_be_met(spark, source):
    with pytest.raises(ValueError, match="budget is"):
        pruning.prune(spark, source, counts(spark, source), 200, leading=SPECIALS)
    with pytest.raises(ValueError, match="can be chosen"):
        pruning.prune(spark, source, counts(spark, source), 5000, leading=SPECIALS)


def test_clashes_are_errors(spark):
    vocab = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "token string, id int, n long")
    with pytest.raises(Exception, match="already in the vocabulary: b"):
        pruning.renumbered(vocab, vocab, pruning.token_list(spark, ["a"]), pruning.token_list(spark, ["b"])).collect()
    with pytest.raises(Exception, match="not in the vocabulary: zz"):
        pruning.protected(vocab, pruning.token_list(spark, ["zz"])).collect()
    assert pruning.special({"<|bos|>": 1}, None) == "<|bos|>"
    with pytest.raises(ValueError):
        pruning.special({"x": 1}, "<s>")


def test_mapping_errors_are_found(spark):
    vocab = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "token string, id int, n long")
    wrong = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "token string, new_id int, old_id int")
    assert [tuple(r) for r in pruning.mapping_errors(wrong, vocab).collect()] == [(0, "a", "b")]


def plain_train(pieces, size):
    """Byte-pair training by its definition, recounting all pairs each round."""
    alphabet = vocabulary.byte_alphabet()
    names = [alphabet[b] for b in sorted(alphabet, key=lambda b: ord(alphabet[b]))]
    words = [([names.index(alphabet[b]) for b in p.encode()], n) for p, n in pieces]
    merges = []
    while len(names) < size:
        total = {}
        for w, n in words:
            for pair in zip(w, w[1:]):
                total[pair] = total.get(pair, 0) + n
        if not total or max(total.values()) < 2:
            break
        pair = min(total, key=lambda p: (-total[p], p))
        names.append(names[pair[0]] + names[pair[1]])
        merges.append((names[pair[0]], names[pair[1]]))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == pair:
                    w[i : i + 2] = [len(names) - 1]
                i += 1
    return merges


def test_training_counts_pieces_that_occur_once(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(40)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = [(r.piece, r.n) for r in vocabulary.piece_counts(docs).collect()]
    assert min(n for _, n in pieces) == 1
    assert vocabulary.train_on(docs, 300)[1] == plain_train(pieces, 300)


def test_training_on_executors_equals_that_on_the_driver(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("aab cé") for _ in range(rng.randint(1, 9))) for _ in range(50)) + " aaaa aaaaa éé" for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = [(r.piece, r.n) for r in vocabulary.piece_counts(docs).collect()]
    for name, value in (("MAX_PIECES", 0), ("GUESS_PIECES", 8), ("GUESS_MERGES", 5), ("BLOCK_PIECES", 7)):
        monkeypatch.setattr(vocabulary, name, value)
    vocab, merges = vocabulary.train_on(docs, 290)
    assert merges == plain_train(pieces, 290) and (vocab, merges) == vocabulary.train(pieces, 290)


def test_roundtrip_with_more_pieces_than_the_driver_trains_on(spark, monkeypatch, tmp_path):
    from corpusforge import plans

    texts = ["xqa xqb\n\n xqc", "Über naïve λ = 3.5", "", None, "don't  stop\t12345 \U0001f600", "xqa " * 300]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(vocabulary, "MAX_PIECES", 4)
    got = {r.doc_id: r.same for r in plans.QUERIES["bpe_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else True for i, t in enumerate(texts)}


def test_selection_fills_the_budget_in_order():
    merges = [(0, "a", "b"), (1, "ab", "c"), (2, "c", "d"), (3, "cd", "a")]
    found = vocabulary.closures(merges, {"a", "b", "c", "d", "ab", "abc", "cd", "cda"}, {"a", "b", "c", "d"})
    assert found["abc"] == {"a", "b", "c", "ab", "abc"} and found["cda"] == {"a", "c", "d", "cd", "cda"}
    assert vocabulary.select(["abc", "cda", "cd"], found, {"a", "b", "c", "d"}, 6) == {"a", "b", "c", "d", "ab", "abc"}
    with pytest.raises(ValueError, match="can't be built"):
        vocabulary.select([], found, {"zz"}, 3)
    with pytest.raises(ValueError, match="can be chosen"):
        vocabulary.select(["ab"], found, {"a"}, 8)


def test_pretokens_join_to_the_text(spark):
    texts = ["", "a  b", TEXT, "x\r\n\r\n y", "it's 12345 o'clock!!", "中文 и  кириллица"]
    from corpusforge.functions import text

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.pretokens(F.col("t")).alias("p")).collect()
    assert all("".join(r.p) == r.t for r in rows)


def test_selection_from_tables_equals_that_from_lists(spark):
    rng = random.Random(5)
    letters = list("abcde")
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40)}
    tokens = sorted({w[:k] for w in words for k in range(1, len(w) + 1)} | set(letters), key=lambda t: (len(t), t))
    vocab = spark.createDataFrame([(t, i, rng.randint(1, 30)) for i, t in enumerate(tokens)], "token string, id int, n long")
    made = [(i, t[:-1], t[-1]) for i, t in enumerate(x for x in tokens if len(x) > 1)]
    merges = spark.createDataFrame(made, "rank int, left string, right string")
    order = [r["token"] for r in vocabulary.ranked(vocab).orderBy("place").collect()]
    closure = vocabulary.closures(made, set(tokens), set(letters))
    for budget in (20, 41, len(tokens)):
        chosen, found = vocabulary.select_spread(vocab, merges, budget, chunk=4)
        assert chosen == vocabulary.select(order, closure, set(letters), budget)
        assert all(found[t] == closure[t] for t in chosen)
    with pytest.raises(ValueError, match="can be chosen"):
        vocabulary.select_spread(vocab, merges, len(tokens) + 1, chunk=400)


def test_numbers_need_no_task_that_sees_all_rows(spark):
    rows = spark.range(1000).selectExpr("concat('t', pmod(id * 7919, 1000)) AS token", "int(id) AS old_id", "int(id % 3) AS class").repartition(5)
    got = vocabulary.remapped(rows)
    assert "SinglePartition" not in got.select("token", "new_id")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    want = {r.token: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r["class"], r.old_id)))}
    assert {r.token: r.new_id for r in got.collect()} == want


def test_what_is_built_of_lost_parts_is_not_reachable(spark):
    atoms = spark.createDataFrame([("a",), ("b",)], "token string")
    merges = spark.createDataFrame([("a", "b"), ("ab", "c"), ("abc", "a"), ("abca", "b"), ("ab", "a"), ("", "zz")], "left string, right string")
    assert {r.token for r in vocabulary.reachable(atoms, merges).collect()} == {"a", "b", "ab", "aba"}


def test_tasks_of_the_numbering_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "RANGE_ROWS", 50, raising=False)
    stored, cut = {}, vocabulary.scratch.cut
    monkeypatch.setattr(vocabulary.scratch, "cut", lambda df, name="cut": stored.setdefault(name, cut(df, name)))
    rows = spark.range(1000).selectExpr("concat('t', pmod(id * 7919, 1000)) AS token", "int(id) AS n").repartition(3)
    got = vocabulary.numbered(rows, "id", F.length("token"), "token")
    assert [r.id for r in got.orderBy(F.length("token"), "token").collect()] == list(range(1000))
    sizes = [r["count"] for r in stored["ranges"].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150


def test_dense_ids_counts_in_ranges(spark, monkeypatch):
    from corpusforge.operators import audit

    monkeypatch.setattr(vocabulary, "RANGE_ROWS", 50, raising=False)
    got = audit.dense_ids(spark.range(1000).selectExpr("int(id) AS id"))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert tuple(got.first()) == (1000, 1000, 999, True)
    for ids, want in (([0, 1, 1, None], (3, 2, 1, False)), ([0, 2], (2, 2, 2, False)), ([], (0, 0, None, None))):
        assert tuple(audit.dense_ids(spark.createDataFrame([(i,) for i in ids], "id int")).first()) == want
