import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import packing, stats
from corpusforge.sources import sinks, tokenshards


def test_report_and_freshness(spark, tmp_path):
    inputs = tmp_path / "in"
    inputs.mkdir()
    (inputs / "a.bin").write_bytes(b"\0\1")
    os.utime(inputs / "a.bin", (time.time() - 100,) * 2)
    sinks.report(spark.createDataFrame([(1, "ok")], "shards int, verdict string"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "report")).select("shards", "verdict").collect()] == [(1, "ok")]
    assert sinks.fresh(spark, str(tmp_path / "report"), str(inputs)).first()["fresh"]
    (inputs / "b.bin").write_bytes(b"\0\1")
    os.utime(inputs / "b.bin", (time.time() + 100,) * 2)
    assert not sinks.fresh(spark, str(tmp_path / "report"), str(inputs)).first()["fresh"]


def test_appends_and_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.25)], "step long, loss double")
    for _ in range(2):
        sinks.append_rows(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    rows.write.parquet(str(tmp_path / "made"))
    for _ in range(2):
        sinks.metrics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "made")), str(tmp_path / "metrics")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "metrics")).collect()) == [(1, 0.5), (2, 0.25)]


def test_tuning_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, "val" if i % 5 == 0 else "train") for i in range(20)], "n long, split string")
    sinks.tuning_files(rows, str(tmp_path / "sft"))
    assert sorted(x for x in os.listdir(tmp_path / "sft") if x.startswith("split")) == ["split=train", "split=val"]
    assert spark.read.parquet(str(tmp_path / "sft")).where("split = 'val'").count() == 4


def test_counts(spark, tmp_path):
    counts = spark.createDataFrame([(0, 5), (1, 0), (2, 7)], "token_id int, n long")
    sinks.counts_with_audit(counts, str(tmp_path / "c"), seed=7)
    audit = spark.read.json(str(tmp_path / "c" / "audit")).first()
    assert (audit.ids, audit.tokens, audit.seen, audit.seed) == (3, 12, 2, 7)
    assert sinks.read_counts(spark, str(tmp_path / "c"), 3).count() == 3
    with pytest.raises(ValueError, match="vocabulary of 2"):
        sinks.read_counts(spark, str(tmp_path / "c"), 2)


def test_array_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abc " * i) for i in range(9)], "doc_id long, text string")
    shards = packing.with_shards(packing.blocks(docs, 16, keep_tail=True), 4).groupBy("split", "shard").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "stream"))), lambda x: x["stream"]), "").alias("stream"))
    names = sinks.array_shards(shards, str(tmp_path / "arrays"))
    got = np.concatenate([np.load(tmp_path / "arrays" / n) for n in sorted(names, key=lambda n: n[-10:])])
    want = [x for i in range(9) for x in [256, *(b"abc " * i)]]
    assert got.tolist() == want and got.dtype == np.uint16
    assert sinks.read_array(sinks.array_bytes(np.arange(5, dtype="<u4"))).tolist() == [0, 1, 2, 3, 4]


def test_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "x.txt").write_bytes(b"abc")
    assert sinks.digests(spark, str(tmp_path), "*.txt").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_shards_that_the_state_lacks(tmp_path):
    meta = {"dtype": "uint16"}
    tokenshards.save_state(str(tmp_path), next_shard=1, completed_docs=3, doc_token_offset=0, metadata=meta)
    state = tokenshards.load_state(str(tmp_path), meta)
    with pytest.raises(ValueError, match="counts 1 shards, the folder holds 0"):
        tokenshards.check_folder(str(tmp_path), state)
    (tmp_path / "c_train_000000.bin").write_bytes(b"")
    tokenshards.check_folder(str(tmp_path), state)
    with pytest.raises(ValueError, match="dtype was 'uint16', now 'uint32'"):
        tokenshards.load_state(str(tmp_path), {"dtype": "uint32"})
    tokenshards.write_json(str(tmp_path), tokenshards.STATE, {"next_shard": 1, "completed_docs": 3, "doc_token_offset": 0, "metadata": meta})
    assert not tokenshards.load_state(str(tmp_path), meta)["complete"]


def test_shortage_is_an_error(spark):
    held = spark.createDataFrame([("a", 5), ("b", 3)], "source string, n long")
    assert {r.source: r.share for r in stats.checked_quota(7, held, "source", "n").collect()} == {"a": 4, "b": 3}
    with pytest.raises(Exception, match="too few rows in stratum b"):
        stats.checked_quota(8, held, "source", "n").collect()


def test_null_ids_keep_their_tokens(spark):
    docs = spark.createDataFrame([(None, "ab"), (3, "c"), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r.off for r in packing.with_offsets(packing.token_counts(docs)).collect()}
    assert got == {None: 0, 1: 3, 3: 4}
