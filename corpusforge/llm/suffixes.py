"""Removal of long repeated byte strings by a distributed difference-cover algorithm.

The suffixes whose starts lie in a difference cover modulo PERIOD are sampled: for any two positions there is one shift,
shorter than the period, that takes both into the sample. The sampled tuples (PERIOD bytes each) are sorted in ranges of
their fingerprints, and a tuple that occurs again is named by its rank among those that do; one that doesn't ends every
suffix that reaches it. Then the algorithm recurses on names: the sampled string of names is sorted again by pairs of
names one period apart, which names strings of twice the length, until what a whole suffix of LENGTH bytes surely holds
is covered. Last the remaining suffixes are merged in: those from which a shift below the period reaches a sampled one
that still repeats are sorted by their first LENGTH bytes, and adjacent ones that agree are repeats.

Order is that of fingerprints, not of bytes: only equal neighbours are asked for, and longer agreement than LENGTH
changes nothing, so neither the text nor the rank of a unique suffix ever travels. Prefixes compare by 80 bits of two
independent polynomials: two different ones agree with probability (suffixes merged)^2 / 2^81 in all. The triples of the
classical cover modulo 3 would sample two suffixes of three; the cover modulo 133 samples 12 of 133.

Defined results: null and empty texts have no bytes; a text shorter than the length is kept whole; matches never cross
documents, but may overlap within one; copies all lose what they share, the first included; rows of one id are judged
each by its own text; ids must be integers or null, others raise TypeError; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs
from corpusforge.llm import scratch, units

LENGTH = 400
#: A perfect difference set, each residue but 0 being the difference of exactly one pair.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_tuples long, kept binary"
NAMED = "unit long, at binary, names binary"


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the sampled tuples that lie within a document, in order of place."""
    n = np.maximum(np.diff(offsets) - PERIOD + 1, 0)
    rounds = -(-n // PERIOD)
    row = np.repeat(np.arange(len(n)), rounds)
    at = (bs.spread(np.zeros(len(n), np.int64), rounds)[:, None] * PERIOD + np.array(COVER)[None, :]).ravel()
    row = np.repeat(row, len(COVER))
    fits = at < n[row]
    at = at[fits] + offsets[:-1][row[fits]]
    return at, bs.Rolling(bs.BYTE_VALUES[0][data]).of(at, at + PERIOD)


def tuples(unit: units.Unit) -> tuple[np.ndarray, np.ndarray]:
    """Places in the unit and fingerprints of its sampled tuples."""
    parts = [(at + unit.offsets[a], h) for a, _, d, o in unit.slices() for at, h in [sampled(d, o)]]
    return np.concatenate([np.zeros(0, np.int64), *(x[0] for x in parts)]), np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in parts)])


def pairs(row: dict, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a name has another one `step` bytes on, and the fingerprints of those pairs of names."""
    at, name = np.frombuffer(row["at"], np.int32), np.frombuffer(row["names"], np.uint64)
    other = np.minimum(np.searchsorted(at, at + step), max(len(at) - 1, 0))
    both = at[other] == at + step
    return at[both], bs.mix(bs.mix(name[both], 12) * bs.U64(0x9E3779B97F4A7C15) + name[other[both]], 13)


def remaining(unit: units.Unit, hits: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice: first row, bytes, offsets, places of the suffixes to merge, and 80 bits of their prefixes."""
    for a, b, d, o in unit.slices():
        base = unit.offsets[a]
        mine = hits[(hits >= base) & (hits < unit.offsets[b])] - base
        at = np.zeros(0, np.int64)
        if len(mine):
            near = bs.covered(np.maximum(mine - PERIOD + 1, 0), PERIOD, len(d))
            n_full, whole = np.maximum(np.diff(o) - length + 1, 0), np.zeros(len(d) + 1, np.int64)
            np.add.at(whole, o[:-1], 1)
            np.add.at(whole, o[:-1] + n_full, -1)
            at = np.flatnonzero(near & (np.cumsum(whole)[:-1] > 0))
        if len(at):
            first, second = (bs.Rolling(table[d]).of(at, at + length) for table in bs.BYTE_VALUES)
            yield a, d, o, at, first, (second >> bs.U64(48)).astype(np.uint16)
        else:
            yield a, d, o, at, np.zeros(0, np.uint64), np.zeros(0, np.uint16)


def _named(number: int, places: np.ndarray, hashes: np.ndarray, replies: list | None) -> pa.RecordBatch | None:
    """The places whose hash repeats, with its name."""
    order, new, kinds, _ = units.distinct(hashes)
    repeats = units.reply_bits(replies)
    if not repeats.any():
        return None
    name = np.zeros(len(kinds), np.int64)
    name[repeats] = units.reply_names(replies)
    own = np.empty(len(hashes), np.int64)
    own[order] = name[np.cumsum(new) - 1]
    kept = own > 0
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([places[kept].astype(np.int32).tobytes()], pa.binary()), pa.array([own[kept].tobytes()], pa.binary())], ["unit", "at", "names"])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_tuples", "kept"])


def _count(named: DataFrame) -> int:
    return (named.select(F.sum(F.length("names"))).first()[0] or 0) // 8


def names_of_tuples(table: DataFrame) -> DataFrame:
    """(unit, at, names): the sampled tuples that occur again."""
    n_bytes = table.select(F.sum("total")).first()[0] or 0

    def emit(batch: pa.RecordBatch) -> Iterator[tuple[int, units.Sent]]:
        for number, unit in units.read_units(batch):
            yield number, (tuples(unit)[1], None, None)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, unit in units.read_units(batch, "replies"):
                if unit.extra["replies"] and (out := _named(number, *tuples(unit), unit.extra["replies"])):
                    yield out

    replies = units.exchange(table, emit, n_bytes * len(COVER) / PERIOD, names=True)
    return scratch.cut(units.told(table, replies).mapInArrow(name, NAMED), "suffix-names")


def names_of_pairs(named: DataFrame, step: int) -> DataFrame:
    """(unit, at, names): the strings of two names, `step` bytes apart, that occur again."""

    def emit(batch: pa.RecordBatch) -> Iterator[tuple[int, units.Sent]]:
        for row in batch.to_pylist():
            yield row["unit"], (pairs(row, step)[1], None, None)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["replies"] and (out := _named(row["unit"], *pairs(row, step), row["replies"])):
                    yield out

    replies = units.exchange(named, emit, _count(named), names=True)
    return scratch.cut(named.join(replies.hint("shuffle_hash"), "unit").mapInArrow(name, NAMED), "suffix-names")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_tuples, kept (if with_bytes).

    n_repeated_tuples counts the document's sampled tuples of PERIOD bytes that are sampled elsewhere too; any string of
    2 x PERIOD - 1 bytes that occurs twice holds one, so repeats too short to be removed show there. length must be
    2 x PERIOD - 1 at least.
    """
    if length < 2 * PERIOD - 1:
        raise ValueError(f"length must be {2 * PERIOD - 1} at least")
    table = units.stored(docs, id_col, text_col, "suffix_units")
    named = names_of_tuples(table)
    scratch.free_shuffles(docs.sparkSession)
    deep, covered = named, PERIOD
    while 2 * covered <= length - PERIOD + 1:  # whatever the shift, a suffix of `length` bytes holds as much from a sampled place on
        deep, covered = names_of_pairs(deep, covered), 2 * covered
        scratch.free_shuffles(docs.sparkSession)
    seeds, hits = named.select("unit", F.col("at").alias("seeds")), deep.select("unit", F.col("at").alias("hits"))
    n_merged = _count(deep) * PERIOD / len(COVER)
    none = np.zeros(0, np.int32)

    def merge(batch: pa.RecordBatch) -> Iterator[tuple[int, units.Sent]]:
        for number, unit in units.read_units(batch, "hits"):
            if unit.extra["hits"]:
                parts = [x[4:] for x in remaining(unit, np.frombuffer(unit.extra["hits"], np.int32), length)]
                yield number, (np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), None)

    replies = units.exchange(units.told(table, hits), merge, n_merged)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, unit in units.read_units(batch, "seeds", "hits", "replies"):
                seeds, hits = (np.frombuffer(unit.extra[x], np.int32) if unit.extra[x] else none for x in ("seeds", "hits"))
                known = np.bincount(np.searchsorted(unit.offsets, seeds, "right") - 1, minlength=len(unit.ids))
                parts = list(remaining(unit, hits, length)) if unit.extra["replies"] else [(a, d, o, none, none, none) for a, _, d, o in unit.slices()]
                again = np.zeros(0, bool)
                if unit.extra["replies"]:
                    order, new, _, _ = units.distinct(np.concatenate([x[4] for x in parts]), np.concatenate([x[5] for x in parts]))
                    again = np.empty(len(order), bool)
                    again[order] = units.reply_bits(unit.extra["replies"])[np.cumsum(new) - 1]
                k = 0
                for a, d, o, at, _, _ in parts:
                    gone = bs.covered(at[again[k : k + len(at)]], length, len(d)) if len(at) else np.zeros(len(d), bool)
                    k += len(at)
                    rows = []
                    for r in range(len(o) - 1):
                        text, cut = d[o[r] : o[r + 1]], gone[o[r] : o[r + 1]]
                        kept = text[~cut].tobytes()
                        rows.append((None if unit.null[a + r] else int(unit.ids[a + r]), len(text), int(cut.sum()), len(bs.runs(cut)[0]), hashlib.sha256(kept).hexdigest(), int(known[a + r]), kept if with_bytes else None))
                    yield _rows(rows)

    return units.told(table, seeds, hits, replies).mapInArrow(finish, RESULT)


def op4_suffix_array(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_tuples")
