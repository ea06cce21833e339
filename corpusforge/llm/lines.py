"""Line deduplication by repeated pairs or content-defined chunks of lines.

Pairs are any two successive lines with words, with the blank lines between; every repeated run of two lines or more is
made of them, so it goes whole, wherever it stands. The first copy of each line stays. The query uses pairs, the pipeline chunks.

Chunks cost fewer rows and find only runs that hold whole chunks. A rolling hash over the last two line hashes decides whether a chunk ends after a line, so boundaries move with the text
and an inserted line disturbs only the chunks around it. Chunks of two or more lines with words that occur again are
grouped by 128-bit hash. Of pairs as of chunks, each later one is compared with the first byte by byte, and removed if equal. What comes first
by (doc_id, place) stays.

Text is shuffled by document only, and of repeated chunks' bytes each once. Defined results: a null text stays null; an
empty one stays empty; rows with a null id are left alone and count for none; rows that repeat an id and a text are treated
alike, rows of one id with other texts each by its own; ids must be integers or null, others raise TypeError; lines part
at line feeds only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs
from corpusforge.llm import scratch, units

MEAN_LINES = 4  # a power of two: a boundary falls after one line in so many
MIN_LINES = 2
P = "__cf_ld_"


class Chunks:
    """Chunks of the documents of one slice: byte ranges, rows, numbers within the row, lines with words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        edge = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
        edge = edge[edge <= offsets[-1]]
        start, end = edge[:-1], edge[1:]
        row = np.searchsorted(offsets, start, "right") - 1
        bare = end - (data[end - 1] == 10) if len(end) else end
        rolls = [bs.Rolling(table[data]) for table in bs.BYTE_VALUES]
        line = rolls[0].of(start, bare)
        same = np.concatenate((row[:1] != row[:1], row[1:] == row[:-1]))
        before = np.where(same, np.concatenate((line[:1], line[:-1])), bs.U64(0))
        ends = (bs.mix(line + bs.U64(3) * before, 8) & bs.U64(MEAN_LINES - 1)) == 0
        last = np.concatenate((row[1:] != row[:-1], row[:1] == row[:1]))
        stop = np.flatnonzero(ends | last)
        first = np.concatenate((stop[:1] * 0, stop[:-1] + 1))
        words = np.concatenate(([0], np.cumsum(~bs.IS_SPACE[data])))
        full = np.concatenate(([0], np.cumsum(words[end] > words[start])))
        self.start, self.end, self.row = start[first], end[stop], row[first]
        self.lines = full[stop + 1] - full[first]
        base = np.searchsorted(self.row, np.arange(len(offsets)))
        self.number = np.arange(len(self.row)) - base[self.row]
        self.base = base
        # The last line of a text may lack its line feed; the hash is of the lines without the final one.
        trimmed = bare[stop]
        self.hashes = [r.of(self.start, trimmed) for r in rolls]
        self.trimmed = trimmed


class Pairs:
    """Any two successive lines with words of one row, as Chunks has its chunks; they overlap."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        edge = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
        start, end = edge[:-1], edge[1:]
        words = np.concatenate(([0], np.cumsum(~bs.IS_SPACE[data])))
        full = words[end] > words[start]
        start, end = start[full], end[full]
        row = np.searchsorted(offsets, start, "right") - 1
        one = np.flatnonzero(row[1:] == row[:-1])
        self.start, self.end, self.row = start[one], end[one + 1], row[one]
        self.lines = np.full(len(one), 2)
        self.base = np.searchsorted(self.row, np.arange(len(offsets)))
        self.number = np.arange(len(one)) - self.base[self.row]
        self.trimmed = self.end - (data[self.end - 1] == 10)
        self.hashes = [bs.Rolling(table[data]).of(self.start, self.trimmed) for table in bs.BYTE_VALUES]


def chunk_rows(text: DataFrame, kind: type = Chunks) -> DataFrame:
    """(doc_id, text) -> h1, h2, doc_id, k for each chunk of enough lines."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(1)):
                c = kind(data, offsets)
                use = np.flatnonzero(c.lines >= MIN_LINES)
                ids = batch.column(0)[a:b].take(pa.array(c.row[use]))
                yield pa.RecordBatch.from_arrays([*(pa.array(h[use].view(np.int64)) for h in c.hashes), ids, pa.array(c.number[use], pa.int64())], ["h1", "h2", "doc_id", "k"])

    return text.mapInArrow(scan, "h1 long, h2 long, doc_id long, k long").where("doc_id is not null")


def chunk_bytes(marked: DataFrame, kind: type = Chunks) -> DataFrame:
    """(doc_id, text, ks) -> doc_id, k, h1, body of the chunks (k, h1) in ks that the text has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(1)):
                c = kind(data, offsets)
                ids, ks, hs, body = [], [], [], []
                for r, (ident, wanted) in enumerate(zip(batch.column(0)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), strict=True)):
                    for k, h1, i in held(c, r, wanted):
                        ids.append(ident)
                        ks.append(k)
                        hs.append(h1)
                        body.append(data[c.start[i] : c.trimmed[i]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(hs, pa.int64()), pa.array(body, pa.binary())], ["doc_id", "k", "h1", "body"])

    return marked.mapInArrow(scan, "doc_id long, k long, h1 long, body binary")


def held(c: Chunks | Pairs, row: int, wanted: list[dict]) -> Iterator[tuple[int, int, int]]:
    """(k, h1, index) of the wanted chunks that the row has: another text of the same id may have other ones."""
    stop = c.base[row + 1] if row + 1 < len(c.base) else len(c.row)
    for x in wanted:
        i = int(c.base[row]) + x["k"]
        if i < stop and int(c.hashes[0][i].view(np.int64)) == x["h1"]:
            yield x["k"], x["h1"], i


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str, kind: type = Chunks) -> DataFrame:
    """(id, ks): for each document the numbers of its chunks that equal an earlier one."""
    units.integer_ids(docs, id_col)
    text = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = scratch.cut(chunk_rows(text, kind), "chunks")
    # What joins text grows with the corpus, so it is never broadcast, even where a small one would fit.
    place = F.struct("doc_id", "k")
    # Written before it is joined, so that the join's sides can be split where a chunk has very many copies.
    spans = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = scratch.cut(spans.where("first <> last").select("h1", "h2", "first"), "chunks-first")
    shared = scratch.cut(rows.join(firsts, ["h1", "h2"]).distinct(), "chunks-shared")
    wanted = shared.groupBy("doc_id").agg(F.collect_set(F.struct("k", "h1")).alias("ks"))
    bodies = scratch.cut(chunk_bytes(text.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "ks"), kind).distinct(), "chunks-bytes")
    scratch.free_shuffles(docs.sparkSession)
    own = shared.where(F.struct("doc_id", "k") != F.col("first")).join(bodies.hint("merge"), ["doc_id", "k", "h1"])
    lead = shared.where(F.struct("doc_id", "k") == F.col("first")).join(bodies.hint("merge"), ["doc_id", "k", "h1"]).select("h1", "h2", F.col("body").alias("first_body"))
    equal = own.join(lead.hint("merge"), ["h1", "h2"]).where("body = first_body")
    out = scratch.cut(equal.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("k", "h1")).alias("ks")), "chunks-equal")
    scratch.forget(rows, firsts, shared, bodies)
    return out


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", report: bool = False, kind: type = Chunks) -> DataFrame:
    """docs with repeated chunks (or Pairs) taken out of their text; report adds chunks_removed, how many were."""
    gone = repeated_chunks(docs, id_col, text_col, kind).select(F.col("id").alias(P + "id"), F.col("ks").alias(P + "ks"))
    joined = docs.join(gone.hint("merge"), docs[id_col].cast("long") == gone[P + "id"], "left").drop(P + "id")
    names = joined.columns
    at, ks_at = names.index(text_col), names.index(P + "ks")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            column, marks = batch.column(at), batch.column(ks_at)
            for a, b, data, offsets in bs.slices(column):
                lists = marks[a:b].to_pylist()
                c = kind(data, offsets) if any(lists) else None
                for r, ks in enumerate(lists):
                    text = data[offsets[r] : offsets[r + 1]]
                    if ks:
                        keep, mine = np.ones(len(text), bool), list(held(c, r, ks))
                        for _, _, i in mine:
                            keep[c.start[i] - offsets[r] : c.end[i] - offsets[r]] = False
                        text = text[keep]
                    texts.append(text.tobytes())
                    removed.append(len(mine) if ks else 0)
            null = np.asarray(column.is_null())
            new = pa.array([None if z else t for t, z in zip(texts, null, strict=True)], pa.binary()).cast(batch.schema.field(at).type)
            out = [new if i == at else batch.column(i) for i in range(len(names)) if i != ks_at]
            kept = [n for n in names if n != P + "ks"]
            if report:
                out, kept = [*out, pa.array(removed, pa.int64())], [*kept, "chunks_removed"]
            yield pa.RecordBatch.from_arrays(out, kept)

    schema = docs.schema
    if report:
        schema = type(schema)([f for f in schema.fields if f.name != "chunks_removed"]).add("chunks_removed", "long")
    return joined.mapInArrow(rewrite, schema)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), report=True, kind=Pairs)
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "chunks_removed", F.sha2("text", 256).alias("kept_sha256"))
