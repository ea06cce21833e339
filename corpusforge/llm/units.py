"""Units of text and exchanges of their hashes.

A unit is one row that holds the documents of a few megabytes. Units are written once, bucketed by their number, and
stay where they are: what other units know about them comes to them by number. A writing task deals its units to many
buckets, so that no bucket, which one task reads, grows with the input's splits. Hashes of a unit are sorted, made
distinct and sent to ranges of the hash order as packed arrays: at most one entry for each hash and unit, so that a
passage that a third of all documents share costs one entry a unit, and a range's size follows the number of different
hashes. Each range sorts what it got and answers each entry with a bit, or with its rank among the repeated ones.
Ranges are chosen by the size of the corpus, so none outgrows a task.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs
from corpusforge.llm import scratch

UNIT_BYTES = 4 << 20
BUCKET_ITEMS = 300_000
UNIT_SCHEMA = "unit long, ids array<long>, sizes binary, total long, body binary"
BUCKET_BYTES = 32 << 20
MAX_BUCKETS = 100_000  # Spark's own default bound for bucketed tables
#: Parquet looks at a group's size only after 100 rows, and a reader's batch holds up to a whole group; rows are megabytes.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.max": "1"}


class Unit(NamedTuple):
    ids: np.ndarray  # int64; the least value stands for null
    null: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    extra: dict[str, object]

    def slices(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        a, n = 0, len(self.ids)
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + bs.SLICE, "right")) - 1))
            yield a, b, self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]
            a = b


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(column.is_null())
    return np.asarray(column.fill_null(-(1 << 63)), np.int64), null


def read_units(batch: pa.RecordBatch, *extra: str) -> Iterator[tuple[int, Unit]]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        ids, null = _ids(batch.column(names.index("ids"))[i].values)
        size = np.frombuffer(batch.column(names.index("sizes"))[i].as_buffer(), np.int64)
        data = np.frombuffer(batch.column(names.index("body"))[i].as_buffer(), np.uint8)
        more = {x: batch.column(names.index(x))[i].as_py() for x in extra}
        yield batch.column(names.index("unit"))[i].as_py(), Unit(ids, null, data, np.concatenate(([0], np.cumsum(size))), more)


def unit_row(number: int, ids: list, sizes: np.ndarray, body: bytes) -> list[pa.Array]:
    return [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.asarray(sizes, np.int64).tobytes()], pa.binary()), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())]


def _home(number: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark's hash of a long puts each number in."""
    u32 = lambda x: np.asarray(x, np.uint64) & bs.U64(0xFFFFFFFF)
    turn = lambda x, r: u32((x << bs.U64(r)) | (x >> bs.U64(32 - r)))
    h = np.full(len(number), 42, np.uint64)
    for part in (u32(number), u32(number >> 32)):
        k = u32(turn(u32(part * bs.U64(0xCC9E2D51)), 15) * bs.U64(0x1B873593))
        h = u32(turn(h ^ k, 13) * bs.U64(5) + bs.U64(0xE6546B64))
    h ^= bs.U64(8)
    h = u32((h ^ (h >> bs.U64(16))) * bs.U64(0x85EBCA6B))
    h = u32((h ^ (h >> bs.U64(13))) * bs.U64(0xC2B2AE35))
    h ^= h >> bs.U64(16)
    return h.astype(np.uint32).view(np.int32).astype(np.int64) % buckets


def numbers(task: int, buckets: int) -> Iterator[int]:
    """Unit numbers of a task, all of one bucket, so that a task writes one file."""
    base, step = task << 32, max(1024, 4 * buckets)
    while True:
        some = np.arange(base, base + step, dtype=np.int64)
        yield from some[_home(some, buckets) == task % buckets].tolist()
        base += step


def dealt(task: int, buckets: int) -> Iterator[int]:
    """Unit numbers of a task in ascending order, of one bucket after another: a task's text may fill many buckets."""
    first, base, step = int(task * 0.6180339887498949 % 1 * buckets), task << 32, max(1024, 8 * buckets)
    for turn in itertools.count():
        while True:
            some = np.arange(base, base + step, dtype=np.int64)
            base += step
            if len(fits := some[_home(some, buckets) == (first + turn) % buckets]):
                break
        yield int(fits[0])


def integer_ids(docs: DataFrame, id_col: str) -> None:
    kind = docs.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids must be integers; {id_col} is {kind}")


def pack(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int = UNIT_BYTES, buckets: int = 1) -> DataFrame:
    """Documents as units; write the result before its numbers are used twice."""
    integer_ids(docs, id_col)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = dealt(TaskContext.get().partitionId(), buckets)
        ids, sizes, parts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(unit_row(next(fresh), ids, np.concatenate(sizes), b"".join(parts)), ["unit", "ids", "sizes", "total", "body"])

        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(1), min(bs.SLICE, unit_bytes)):
                if held and held + len(data) > unit_bytes:
                    yield row()
                    ids, sizes, parts, held = [], [], [], 0
                ids += batch.column(0)[a:b].to_pylist()
                sizes.append(np.diff(offsets))
                parts.append(data.tobytes())
                held += len(data)
        if ids:
            yield row()

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(fill, UNIT_SCHEMA)


def stored(docs: DataFrame, id_col: str, text_col: str, name: str, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """The documents as units in a table of the shared folder, bucketed by unit, so that joins by unit don't move bodies."""
    spark = docs.sparkSession
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # beyond that Spark says that it doesn't know
    # Fewer buckets than shuffle partitions, and Spark would rather move the bodies.
    # A bucket is what a task holds at once, in the JVM and again in Python. Text is counted too: equal texts take next to
    # nothing in a file, and of some sources Spark doesn't know the size.
    text = docs.select(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(max(2 * size, text) / BUCKET_BYTES)))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch.shared_dir(spark)}/{table}"
    pack(docs, id_col, text_col, unit_bytes, buckets).write.options(path=path, compression="zstd", **SMALL_GROUPS).bucketBy(buckets, "unit").saveAsTable(table)
    out = spark.table(table)
    out._corpusforge_path, out._corpusforge_table = path, table
    return out


def told(units: DataFrame, *answers: DataFrame) -> DataFrame:
    """Units with the answers that came for them, null where none came; answers have a row a unit at most."""
    for x in answers:
        units = units.join(x.hint("shuffle_hash"), "unit", "left")
    return units


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: equal high bytes lie together, and the shuffle's compression drops them."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(body: bytes | pa.Buffer, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, -1).T).view(kind).ravel()


def gaps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as the first and the distances to the next: fewer bytes for the many hashes of a bucket."""
    return np.concatenate((x[:1], x[1:] - x[:-1]))


def bucket_bits(items: float) -> int:
    return max(6, math.ceil(math.log2(max(1.0, items / BUCKET_ITEMS))))


def distinct(hashes: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The order of equal hashes, where each different one begins in it, and the different ones (with more bits, if given)."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    return order, new, hashes[order][new], None if more is None else more[order][new]


def first_of(hashes: np.ndarray, more: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (hash, more bits, keys), and where each different hash with its bits begins in it."""
    order = np.lexsort((*keys[::-1], more, hashes))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, new


#: What a unit sends: hashes, 16 more bits of each or none, keys of which the least comes first (with more bits) or none.
Sent = tuple[np.ndarray, np.ndarray | None, np.ndarray | None]


def exchange(sources: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[tuple[int, Sent]]], items: float, names: bool = False) -> DataFrame:
    """(unit, replies): for each of a unit's distinct hashes in order, whether it repeats; emit gives what a unit sends.

    Without keys, a hash repeats if the unit has it twice or another unit has it too; with keys, if another has it with a
    lesser key, or an equal key and a lesser unit number. With names, replies hold the ranks of those that repeat.
    """
    bits = bucket_bits(items)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, (hashes, more, keys) in emit(batch):
                if not len(hashes):
                    continue
                if keys is None:
                    order, new, kinds, more = distinct(hashes, more)
                    start = np.flatnonzero(new)
                    twice, least = np.diff(np.append(start, len(hashes))) > 1, None
                else:
                    order, new = first_of(hashes, more, keys)
                    kinds, more, least, twice = hashes[order][new], more[order][new], keys[order][new], None
                slot = (kinds >> bs.U64(64 - bits)).astype(np.int64)
                edge = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
                stop = np.append(edge[1:], len(slot))

                def cut(x: np.ndarray | None, f: Callable[[np.ndarray], bytes], a=edge, b=stop) -> pa.Array:
                    return pa.nulls(len(a), pa.binary()) if x is None else pa.array([f(x[i:j]) for i, j in zip(a, b, strict=True)], pa.binary())

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot[edge], pa.int32()),
                        pa.array(np.full(len(edge), number), pa.int64()),
                        cut(kinds, lambda x: planes(gaps(x))),
                        cut(more, lambda x: x.tobytes()),
                        cut(least, planes),
                        cut(twice, lambda x: np.packbits(x).tobytes()),
                    ],
                    ["bucket", "unit", "hashes", "more", "keys", "twice"],
                )

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(from_planes(x.as_buffer(), np.uint64)) for x in table["hashes"]]
        size = np.array([len(x) for x in lists])
        h = np.concatenate(lists)
        flag = np.zeros(len(h), bool)
        ranks: list = [None] * len(lists)
        stop = np.cumsum(size)
        more = None if table["more"].null_count else np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table["more"]])
        if table["keys"].null_count:
            order, new, _, _ = distinct(h, more)
            start = np.flatnonzero(new)
            many = np.diff(np.append(start, len(h))) > 1
            group = np.cumsum(new) - 1
            twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(table["twice"], size, strict=True)]).astype(bool)
            many |= np.logical_or.reduceat(twice[order], start)
            flag[order] = many[group]
            if names:
                rank = np.zeros(len(h), np.int64)
                rank[order] = (np.cumsum(many) + (table["bucket"][0].as_py() << 40))[group]
                ranks = [planes(gaps(rank[b - n : b][flag[b - n : b]])) for n, b in zip(size, stop, strict=True)]
        else:
            key = np.concatenate([from_planes(x.as_buffer(), np.int64) for x in table["keys"]])
            order, new = first_of(h, more, key, np.repeat(table["unit"].to_numpy(), size))
            flag[order[~new]] = True
        out = [np.packbits(flag[b - n : b]).tobytes() for n, b in zip(size, stop, strict=True)]
        return pa.table({"unit": table["unit"], "bucket": table["bucket"], "n": pa.array(size, pa.int32()), "bits": pa.array(out, pa.binary()), "names": pa.array(ranks, pa.binary())})

    sent = sources.mapInArrow(send, "bucket int, unit long, hashes binary, more binary, keys binary, twice binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "unit long, bucket int, n int, bits binary, names binary")
    return answers.groupBy("unit").agg(F.collect_list(F.struct("bucket", "n", "bits", "names")).alias("replies"))


def reply_bits(replies: list | None) -> np.ndarray:
    """The bits of a unit's distinct hashes, in the order of the hashes."""
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(replies or [], key=lambda x: x["bucket"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def reply_names(replies: list | None) -> np.ndarray:
    """The names of a unit's distinct hashes that repeat, in the order of the hashes."""
    parts = [np.cumsum(from_planes(x["names"], np.int64)) for x in sorted(replies or [], key=lambda x: x["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
