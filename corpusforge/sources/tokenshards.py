"""Flat token shards (`<prefix>_<split>_<six digits>.bin`, little-endian ids) as a Python data source, and their listing.

Reading gives one partition for each slice of a shard, so a large shard is read by many tasks. Writing goes to a hidden
name first and is renamed when the task commits; a failed job leaves no shard behind. Paths are those of a file system
that all nodes mount; other stores are read through binary_shards, which needs only Spark's own readers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = re.compile(r"^(?P<prefix>.+)_(?P<split>[a-z]+)_(?P<shard>\d{6})\.bin$")
SCHEMA = "split string, shard int, pos long, token long"
DTYPES = {"uint16": np.dtype("<u2"), "uint32": np.dtype("<u4")}
SLICE_TOKENS = 4 << 20


@dataclass
class Slice(InputPartition):
    path: str
    split: str
    shard: int
    first: int
    count: int
    dtype: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


@dataclass
class Written(WriterCommitMessage):
    files: list


class TokenShards(DataSource):
    """spark.read.format("tokenshards").option("dtype", "uint16").option("split", "train").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "tokenshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(dict(self.options), overwrite)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.split = options["path"].removeprefix("file:"), options.get("split")
        self.dtype = options.get("dtype") or read_metadata(self.folder)["dtype"]

    def partitions(self) -> list[Slice]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            m = NAME.match(name)
            if not m or (self.split and m["split"] != self.split):
                continue
            size, item = os.path.getsize(path := os.path.join(self.folder, name)), DTYPES[self.dtype].itemsize
            if size % item:
                raise ValueError(f"{name}: {size} bytes aren't whole {self.dtype} ids")
            n = size // item
            out += [Slice(path, m["split"], int(m["shard"]), a, min(SLICE_TOKENS, n - a), self.dtype) for a in range(0, n, SLICE_TOKENS)]
        return out or [Slice("", "", 0, 0, 0, self.dtype)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        kind = DTYPES[part.dtype]
        ids = np.fromfile(part.path, kind, part.count, offset=part.first * kind.itemsize)
        for a in range(0, len(ids), 1 << 18):
            some = ids[a : a + (1 << 18)].astype(np.int64)
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([part.split] * n), pa.array(np.full(n, part.shard, np.int32)), pa.array(np.arange(part.first + a, part.first + a + n)), pa.array(some)], ["split", "shard", "pos", "token"])


class ShardWriter(DataSourceArrowWriter):
    """Writes rows of (split, shard, stream) - a shard's ids as fixed-width hex digits - one file for each row."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.prefix = options["path"].removeprefix("file:"), options.get("prefix", "corpus")
        self.dtype, self.block = options.get("dtype", "uint16"), int(options.get("block", "1"))
        self.digits, self.bos = int(options.get("digits", "2")), options.get("bos")
        if not overwrite and os.path.isdir(self.folder) and any(NAME.match(x) for x in os.listdir(self.folder)):
            raise FileExistsError(f"{self.folder} holds shards already; resume or choose another folder")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for batch in batches:
            for row in batch.to_pylist():
                ids = hex_ids(row["stream"], self.digits, self.bos)
                if len(ids) % self.block:
                    raise ValueError(f"shard {row['shard']}: {len(ids)} ids aren't whole blocks of {self.block}")
                if len(ids) and ids.max() > np.iinfo(DTYPES[self.dtype]).max:
                    raise ValueError(f"shard {row['shard']}: id {ids.max()} doesn't fit {self.dtype}")
                final = os.path.join(self.folder, f"{self.prefix}_{row['split']}_{row['shard']:06d}.bin")
                hidden = os.path.join(self.folder, f".{os.path.basename(final)}.{os.getpid()}")
                ids.astype(DTYPES[self.dtype]).tofile(hidden)
                files.append((hidden, final))
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        for m in messages:
            for hidden, final in m.files if m else ():
                os.replace(hidden, final)

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            for hidden, _ in m.files if m else ():
                if os.path.exists(hidden):
                    os.remove(hidden)


def hex_ids(stream: str, digits: int, bos: str | None) -> np.ndarray:
    """Ids of fixed-width hex digits; `bos` is the id that a pair of number signs stands for."""
    if digits == 2:
        raw = np.frombuffer(stream.encode(), np.uint8).reshape(-1, 2)
        value = np.zeros(256, np.int64)
        for c in b"0123456789ABCDEF":
            value[c] = int(chr(c), 16)
        ids = value[raw[:, 0]] * 16 + value[raw[:, 1]]
        return np.where(raw[:, 0] == ord("#"), int(bos or 256), ids)
    return np.array([int(stream[i : i + digits], 16) for i in range(0, len(stream), digits)], np.int64)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)


def listing(spark: SparkSession, folder: str, item_bytes: int) -> DataFrame:
    """path, split, shard, n_tokens, aligned of the shards in a folder, by Spark's own listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length", "modificationTime")
    base = F.element_at(F.split("path", "/"), -1)
    m = lambda g: F.regexp_extract(base, r"^(.+)_([a-z]+)_(\d{6})\.bin$", g)
    return files.select("path", m(2).alias("split"), m(3).try_cast("int").alias("shard"), F.floor(F.col("length") / item_bytes).alias("n_tokens"), (F.col("length") % item_bytes == 0).alias("aligned"), "modificationTime").where("shard IS NOT NULL")


def binary_shards(spark: SparkSession, folder: str, item_bytes: int) -> DataFrame:
    """split, shard, pos, token from any store that Spark reads; a shard must fit a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    step = 2 * item_bytes
    swap = "||".join(f"substr(h, i * {step} + {2 * k + 1}, 2)" for k in reversed(range(item_bytes)))
    digits = files.select(F.regexp_extract(base, r"_([a-z]+)_\d{6}\.bin$", 1).alias("split"), F.regexp_extract(base, r"_(\d{6})\.bin$", 1).cast("int").alias("shard"), F.hex("content").alias("h"))
    each = digits.where("h <> ''").select("split", "shard", "h", F.expr(f"explode(sequence(0, cast(length(h) / {step} as int) - 1)) AS i"))
    return each.select("split", "shard", F.col("i").cast("long").alias("pos"), F.expr(f"cast(conv({swap}, 16, 10) as long)").alias("token"))


#: The keys that describe a folder of shards.
KEYS = ("format_version", "dtype", "vocab_size", "max_token_id", "bos_token", "bos_id", "block_size", "shard_size", "tokenizer_sha256", "dataset", "val_shards")
META, STATE = "metadata.json", "checkpoint.json"


def check_metadata(meta: dict) -> dict:
    """The record itself, if it is complete and consistent; else an error that names what is wrong."""
    wrong = [f"{k} is missing" for k in KEYS if k not in meta]
    if not wrong:
        rules = {
            "format_version must be 1": meta["format_version"] == 1,
            "dtype must be uint16 or uint32": meta["dtype"] in DTYPES,
            "the vocabulary must fit the dtype": meta["dtype"] in DTYPES and 0 < meta["vocab_size"] <= np.iinfo(DTYPES[meta["dtype"]]).max + 1,
            "ids must be dense": meta["max_token_id"] == meta["vocab_size"] - 1,
            "bos_id must be an id": 0 <= meta["bos_id"] < meta["vocab_size"],
            "a shard must hold a block": 0 < meta["block_size"] <= meta["shard_size"],
        }
        wrong = [k for k, ok in rules.items() if not ok]
    if wrong:
        raise ValueError("shard metadata: " + "; ".join(wrong))
    return meta


def write_json(folder: str, name: str, record: dict) -> None:
    """Sorted keys, two spaces, a line feed at the end; complete or not there at all."""
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{name}.{os.getpid()}")
    with open(hidden, "w") as f:
        f.write(json.dumps(record, indent=2, sort_keys=True) + "\n")
    os.replace(hidden, os.path.join(folder, name))


def read_metadata(folder: str, *, allow_legacy: bool = True) -> dict:
    path = os.path.join(folder, META)
    if not os.path.exists(path):
        if allow_legacy:
            return {"format_version": 0, "dtype": "uint16", "legacy": True}
        raise FileNotFoundError(path)
    with open(path) as f:
        return check_metadata(json.load(f))


def save_state(folder: str, *, next_shard: int, completed_docs: int, doc_token_offset: int, metadata: dict, complete: bool = False) -> None:
    write_json(folder, STATE, {"next_shard": next_shard, "completed_docs": completed_docs, "doc_token_offset": doc_token_offset, "metadata": metadata, "complete": complete})


def load_state(folder: str, expected: dict) -> dict:
    """The state to resume from, or an error that names all that is wrong with it; `complete` may be absent."""
    with open(os.path.join(folder, STATE)) as f:
        state = {"complete": False} | json.load(f)
    counts = {k: state.get(k) for k in ("next_shard", "completed_docs", "doc_token_offset")}
    kept = state.get("metadata") or {}
    faults = [f"{k} is negative or no number: {v!r}" for k, v in counts.items() if not isinstance(v, int) or v < 0]
    faults += [f"{k} was {kept.get(k)!r}, now {v!r}" for k, v in sorted(expected.items()) if kept.get(k) != v]
    faults += ["the run is complete"] * bool(state["complete"])
    if faults:
        raise ValueError("checkpoint: " + "; ".join(faults))
    return state


def check_folder(folder: str, state: dict) -> None:
    """A resumed run needs as many shards in its folder as its state has counted."""
    found = sum(bool(NAME.match(x)) for x in os.listdir(folder))
    if found != state["next_shard"]:
        raise ValueError(f"the state counts {state['next_shard']} shards, the folder holds {found}")
