"""Substring deduplication by seed and extend over words.

Seeds are winnowed anchors: any window of WINDOW words holds one, and equal windows hold one of equal hash. Units that
hold an equal anchor meet at it, and only places around anchors that repeat need a look. Extension runs both ways from
each seed, over all windows that hold it: a window whose words also start earlier in the corpus is part of a match, and
matching windows that overlap merge into maximal repeats, of WINDOW words at least.

Order is (doc_id, start). Windows compare by 80 bits of two independent hashes of their words, which confuse two
different windows with probability (windows around seeds)^2 / 2^81 in all. Defined results: null and empty texts have no
words; a null id orders before all others; rows with equal ids order as they lie in the table's units; ids must be
integers or null, others raise TypeError; an empty table gives no rows.
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

WINDOW, GRAM = 20, 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class Words:
    """The words of one slice, with the hashes of all grams and windows that stay within a document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> None:
        start, end, self.before = bs.word_bounds(data, offsets)
        self.n = np.diff(self.before)
        self.rolls = [bs.Rolling(bs.word_hashes(data, start, end, table)) for table in (0, 1)]
        self.at, self.row = bs.windows(self.before, window)
        self.size, self.gram = window, gram
        grams, _ = bs.windows(self.before, gram)
        pick = bs.winnow(self.rolls[0].of(grams, grams + gram), window - gram + 1)
        self.anchor_at = grams[pick]
        self.anchor = self.rolls[0].of(self.anchor_at, self.anchor_at + gram)

    def around(self, hit: np.ndarray) -> np.ndarray:
        """A mask of the windows that hold one of the anchors marked in hit: what lies within reach to both sides."""
        reach = self.size - self.gram
        near = bs.spread(self.anchor_at[hit] - reach, np.full(int(hit.sum()), reach + 1))
        zone = np.zeros(self.before[-1] + 1, bool)
        zone[near[near >= 0]] = True
        return zone[self.at]

    def hashes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """80 bits of the windows in some."""
        at = self.at[some]
        first, second = (r.of(at, at + self.size) for r in self.rolls)
        return first, (second >> bs.U64(48)).astype(np.uint16)


def _digest(data: np.ndarray, removed: np.ndarray | None, text: bool) -> tuple[str, str | None]:
    words = data.tobytes().split()
    if removed is not None:
        words = [w for w, gone in zip(words, removed, strict=True) if not gone]
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if text else None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if with_text, kept_text (words by one space)."""
    table = units.stored(docs, id_col, text_col, "substring_units")
    n_bytes = table.select(F.sum("total")).first()[0] or 0
    none = np.zeros(0, np.uint64)

    def parts(unit: units.Unit) -> list[tuple[int, Words, np.ndarray, np.ndarray]]:
        return [(a, Words(d, o, window, gram), d, o) for a, _, d, o in unit.slices()]

    def seeds(batch: pa.RecordBatch) -> Iterator[tuple[int, units.Sent]]:
        for number, unit in units.read_units(batch):
            yield number, (np.concatenate([none, *(w.anchor for _, w, _, _ in parts(unit))]), None, None)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each unit with repeated anchors the bits of its windows that hold one."""
        for batch in batches:
            for number, unit in units.read_units(batch, "replies"):
                repeats = units.reply_bits(unit.extra["replies"])
                if not repeats.any():
                    continue
                every = parts(unit)
                order, new, _, _ = units.distinct(np.concatenate([w.anchor for _, w, _, _ in every]))
                hit = np.empty(len(order), bool)
                hit[order] = repeats[np.cumsum(new) - 1]
                masks, k = [], 0
                for _, w, _, _ in every:
                    mine, k = hit[k : k + len(w.anchor)], k + len(w.anchor)
                    masks.append(w.around(mine))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(np.concatenate(masks)).tobytes()], pa.binary()), pa.array([int(sum(m.sum() for m in masks))], pa.int64())], ["unit", "mask", "asked"])

    replies = units.exchange(table, seeds, n_bytes / 40)
    near = scratch.cut(units.told(table, replies).mapInArrow(extend, "unit long, mask binary, asked long"), "substring-near")
    del replies
    scratch.free_shuffles(docs.sparkSession)
    masks, n_asked = near.select("unit", "mask"), near.select(F.sum("asked")).first()[0] or 0

    def asked(unit: units.Unit, every: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """80 bits, document row and start of the windows in question of each slice."""
        mask, k = np.unpackbits(np.frombuffer(unit.extra["mask"], np.uint8), count=sum(len(w.at) for _, w, _, _ in every)).astype(bool), 0
        for a, w, _, _ in every:
            some, k = np.flatnonzero(mask[k : k + len(w.at)]), k + len(w.at)
            yield *w.hashes(some), w.row[some] + a, w.at[some] - w.before[w.row[some]]

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[int, units.Sent]]:
        for number, unit in units.read_units(batch, "mask"):
            if unit.extra["mask"]:
                found = list(asked(unit, parts(unit)))
                yield number, (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), unit.ids[np.concatenate([x[2] for x in found])])

    later = units.exchange(units.told(table, masks), windows, n_asked)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, unit in units.read_units(batch, "mask", "replies"):
                rows = []
                if not unit.extra["replies"]:
                    for a, _, d, o in unit.slices():
                        n = np.diff(bs.word_bounds(d, o)[2])
                        rows += [(None if unit.null[a + r] else int(unit.ids[a + r]), int(n[r]), 0, *_digest(d[o[r] : o[r + 1]], None, with_text)) for r in range(len(n))]
                    yield _rows(rows)
                    continue
                every = parts(unit)
                found = list(asked(unit, every))
                h, more, row, start = (np.concatenate([x[i] for x in found]) for i in range(4))
                order, new = units.first_of(h, more, unit.ids[row], row, start)
                gone = np.zeros(len(h), bool)
                gone[order] = units.reply_bits(unit.extra["replies"])[np.cumsum(new) - 1] | ~new
                k = 0
                for (a, w, d, o), x in zip(every, found, strict=True):
                    mine, k = gone[k : k + len(x[0])], k + len(x[0])
                    at = x[3][mine] + w.before[x[2][mine] - a]
                    removed = bs.covered(at, window, int(w.before[-1]))
                    for r in range(len(w.n)):
                        cut = removed[w.before[r] : w.before[r + 1]]
                        rows.append((None if unit.null[a + r] else int(unit.ids[a + r]), int(w.n[r]), int(cut.sum()), *_digest(d[o[r] : o[r + 1]], cut if cut.any() else None, with_text)))
                yield _rows(rows)

    return units.told(table, masks, later).mapInArrow(finish, RESULT)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
