"""Files beside the token shards: reports, logs, tuning data, counts, array shards, tokenizer bundles.

Rows go through Spark's own writers to any store; small records of the driver (reports, bundles) are one-row tables too.
"""

from __future__ import annotations

import io
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.sources import tokenshards

#: The first bytes of the array format, version 1.0.
MAGIC = b"\x93NUMPY\x01\x00"


def report(record: DataFrame, path: str) -> None:
    """A one-row table as a JSON file."""
    record.coalesce(1).write.mode("overwrite").json(path)


def fresh(spark: SparkSession, report_path: str, inputs: str, pattern: str = "*.bin") -> DataFrame:
    """report_time, newest_input, fresh: whether the report is at least as new as every input; a missing report isn't."""
    files = lambda path, glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("modificationTime")
    made = files(report_path, "*.json").agg(F.min("modificationTime").alias("report_time"))
    newest = files(inputs, pattern).agg(F.max("modificationTime").alias("newest_input"))
    return made.crossJoin(newest).withColumn("fresh", F.coalesce(F.col("report_time") >= F.col("newest_input"), F.lit(False)))  # one row each


def append_rows(rows: DataFrame, path: str) -> None:
    """JSON lines behind those that are there: loads of experts, metrics of a run."""
    rows.write.mode("append").json(path)


def metrics(rows: DataFrame, path: str):
    """A streaming table of metrics (step, ...) appended to a folder; it runs over what is there and stops."""
    sink = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path.rstrip('/')}_offsets").outputMode("append")
    return sink.trigger(availableNow=True).start()


def tuning_files(examples: DataFrame, path: str) -> None:
    """Examples by their column `split`, a folder for each."""
    examples.write.mode("overwrite").partitionBy("split").parquet(path)


def counts_with_audit(counts: DataFrame, path: str, **facts: object) -> None:
    """counts (token_id, n) as a table, and beside it one row on how they were made."""
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    totals = counts.agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("seen"))
    report(totals.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]), f"{path}/audit")


def read_counts(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Counts of a vocabulary of `size` ids; an id beyond it, a negative count or an id twice is an error."""
    counts = spark.read.parquet(f"{path}/counts")
    facts = counts.agg(F.max("token_id").alias("most"), F.min("token_id").alias("least"), F.min("n").alias("fewest"), F.count(F.lit(1)).alias("rows"), F.count_distinct("token_id").alias("ids")).first()
    if facts["rows"] and (facts["most"] >= size or facts["least"] < 0 or facts["fewest"] < 0 or facts["rows"] != facts["ids"]):
        raise ValueError(f"counts don't fit a vocabulary of {size}: {facts.asDict()}")
    return counts


def array_bytes(ids: np.ndarray) -> bytes:
    """An array of ids in the array format: magic, header padded to 64 bytes, data."""
    head = repr({"descr": ids.dtype.str, "fortran_order": False, "shape": ids.shape}).encode()
    pad = -(len(MAGIC) + 2 + len(head) + 1) % 64
    head += b" " * pad + b"\n"
    return MAGIC + struct.pack("<H", len(head)) + head + ids.tobytes()


def array_shards(shards: DataFrame, folder: str, *, prefix: str = "corpus", digits: int = 2, dtype: str = "uint16", bos: int = 256) -> list[str]:
    """Rows (split, shard, stream) as array files, the last one partial; returns their names."""
    kind = tokenshards.DTYPES[dtype]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                ids = tokenshards.hex_ids(row["stream"], digits, str(bos))
                if len(ids) and ids.max() > np.iinfo(kind).max:
                    raise ValueError(f"shard {row['shard']}: id {ids.max()} doesn't fit {dtype}")
                name = f"{prefix}_{row['split']}_{row['shard']:06d}.npy"
                hidden = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(hidden, "wb") as f:
                    f.write(array_bytes(ids.astype(kind)))
                os.replace(hidden, os.path.join(folder, name))
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    os.makedirs(folder, exist_ok=True)
    return sorted(r["name"] for r in shards.select("split", "shard", "stream").mapInArrow(write, "name string").collect())


def read_array(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content))


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256 of the files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def bundle(folder: str, model: dict, ids: DataFrame, inverse: DataFrame, counts: DataFrame, manifest: dict) -> None:
    """A pruned tokenizer: model, both id maps, the vocabulary as a table of id, old id, token and count, a manifest."""
    tokenshards.write_json(folder, "tokenizer.json", model)
    rows = ids.join(counts.select(F.col("id").alias("old_id"), "n"), "old_id", "left").orderBy("new_id").collect()
    tokenshards.write_json(folder, "new_to_old.json", {"ids": [r["old_id"] for r in rows]})
    tokenshards.write_json(folder, "old_to_new.json", {"ids": [r["new_id"] for r in inverse.orderBy("old_id").collect()]})
    lines = "".join(f"{r['new_id']}\t{'' if r['old_id'] is None else r['old_id']}\t{r['token']!r}\t{r['n'] or 0}\n" for r in rows)
    with open(os.path.join(folder, "vocab.txt"), "w", encoding="utf-8") as f:
        f.write(lines)
    specials = {x["content"]: x["id"] for x in model["added_tokens"]}
    tokenshards.write_json(folder, "special_tokens.json", specials)
    tokenshards.write_json(folder, "manifest.json", manifest | {"vocab_size": len(rows), "merges": len(model["model"]["merges"]), "model_bytes": len(json.dumps(model))})
