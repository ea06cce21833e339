import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import packing
from corpusforge.sources import corpora, tokenshards
from corpusforge.streaming.packer import pack_stream

META = {"format_version": 1, "dtype": "uint16", "vocab_size": 257, "max_token_id": 256, "bos_token": "##", "bos_id": 256, "block_size": 4, "shard_size": 8, "tokenizer_sha256": "x", "dataset": "d", "val_shards": 1}


def test_shards_written_and_read_back(spark, tmp_path):
    tokenshards.register(spark)
    docs = spark.createDataFrame([(i, "héllo " * i) for i in range(9)], "doc_id long, text string")
    blocks = packing.with_shards(packing.blocks(docs, 4), 2)
    shards = blocks.groupBy("split", "shard").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "stream"))), lambda x: x["stream"]), "").alias("stream"))
    folder = str(tmp_path / "shards")
    shards.select("split", F.col("shard").cast("int"), "stream").write.format("tokenshards").option("block", "4").mode("append").save(folder)
    want = [x for i in range(9) for x in [256, *("héllo " * i).encode()]]
    want = want[: len(want) // 4 * 4]
    got = [r.token for r in spark.read.format("tokenshards").option("dtype", "uint16").load(folder).orderBy("shard", "pos").collect()]
    assert got == want
    also = [r.token for r in tokenshards.binary_shards(spark, folder, 2).orderBy("shard", "pos").collect()]
    assert also == want
    assert tokenshards.listing(spark, folder, 2).agg(F.sum("n_tokens")).first()[0] == len(want)
    with pytest.raises(Exception, match="holds shards already"):
        shards.select("split", F.col("shard").cast("int"), "stream").write.format("tokenshards").mode("append").save(folder)


def test_uneven_shard_is_refused(spark, tmp_path):
    tokenshards.register(spark)
    (tmp_path / "c_train_000000.bin").write_bytes(b"\1\2\3")
    with pytest.raises(Exception, match="whole uint16 ids"):
        spark.read.format("tokenshards").option("dtype", "uint16").load(str(tmp_path)).count()


def test_metadata(tmp_path):
    folder = str(tmp_path)
    assert tokenshards.read_metadata(folder)["legacy"]
    with pytest.raises(FileNotFoundError):
        tokenshards.read_metadata(folder, allow_legacy=False)
    tokenshards.write_json(folder, tokenshards.META, META)
    assert tokenshards.read_metadata(folder) == META
    for key, value in (("dtype", "int8"), ("bos_id", 257), ("vocab_size", 70000), ("block_size", 0)):
        with pytest.raises(ValueError):
            tokenshards.check_metadata(META | {key: value})
    with pytest.raises(ValueError, match="missing"):
        tokenshards.check_metadata({"dtype": "uint16"})


def test_state(tmp_path):
    folder = str(tmp_path)
    tokenshards.save_state(folder, next_shard=2, completed_docs=3, doc_token_offset=4, metadata=META)
    assert tokenshards.load_state(folder, META)["next_shard"] == 2
    with pytest.raises(ValueError, match="block_size"):
        tokenshards.load_state(folder, META | {"block_size": 8})
    tokenshards.save_state(folder, next_shard=2, completed_docs=3, doc_token_offset=4, metadata=META, complete=True)
    with pytest.raises(ValueError, match="complete"):
        tokenshards.load_state(folder, META)
    tokenshards.save_state(folder, next_shard=-1, completed_docs=3, doc_token_offset=4, metadata=META)
    with pytest.raises(ValueError, match="negative"):
        tokenshards.load_state(folder, META)


def test_items(spark, tmp_path):
    path = tmp_path / "arc.json"
    rows = [
        {"question": "q", "choices": {"text": ["a", "b"], "label": ["A", "B"]}, "answerKey": "B"},
        {"question_stem": "s", "choices": {"text": ["a", "b"], "label": ["1", "2"]}, "answerKey": "1"},
        {"question": "bad", "choices": {"text": ["a"], "label": ["A"]}, "answerKey": "Z"},
    ]
    path.write_text("\n".join(map(json.dumps, rows)))
    got = {(r.context, r.label) for r in corpora.keyed_items(spark, str(path)).collect()}
    assert got == {("q", 1), ("s", 0)}

    def broken():
        raise OSError("not there")

    both = corpora.registry({"one": lambda: corpora.keyed_items(spark, str(path)), "two": broken})
    assert {r.task for r in both.collect()} == {"one"}


def test_tokenizer_model(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}}))
    vocab, merges = corpora.tokenizer_model(spark, str(tmp_path / "t.json"))
    assert {(r.token, r.id) for r in vocab.collect()} == {("a", 0), ("b", 1), ("ab", 2)}
    assert [(r.rank, r.left, r.right) for r in merges.collect()] == [(0, "a", "b")]


def test_stream_packs_as_the_batch_does(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    docs = [spark.createDataFrame([(i, f"text {i} " * (i % 5)) for i in range(a, a + 10)], "doc_id long, text string") for a in (0, 10, 20)]
    for d in docs:
        d.coalesce(1).write.mode("append").parquet(source)
        pack_stream(spark.readStream.schema("doc_id long, text string").parquet(source), folder, 16).awaitTermination()
    every = docs[0].union(docs[1]).union(docs[2])
    want = {(r.block, r.stream) for r in packing.blocks(every, 16).collect()}
    got = {(r.block, r.stream) for r in spark.read.parquet(os.path.join(folder, "blocks")).collect()}
    assert got == want


def test_hex_ids():
    assert tokenshards.hex_ids("##41C3", 2, None).tolist() == [256, 65, 195]
    assert tokenshards.hex_ids("00410100", 4, None).tolist() == [65, 256]
    assert np.dtype("<u2") == tokenshards.DTYPES["uint16"]
