"""Quality classifier trained from weak labels.

Overlapping heuristic labellers vote on every document; documents are counted by pattern of votes (at most 3^labellers
rows), and expectation-maximisation over those counts estimates how reliable each labeller is. The posterior labels of
a bounded sample then train a linear scorer on hashed events, which scores every document. Text never shuffles.

Defined results: a null or empty text has no events, scores 0 and is rejected; an empty table gives an empty result;
repeated rows score alike; a document whose probability equals the threshold is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs

DIMS = 1 << 12
SAMPLE = 3000  # documents that train the scorer, at most: the only bound that the corpus can reach
THRESHOLD = 0.35
LABELLERS = ("length", "symbols", "marks", "symbol_words", "capitals", "calls", "echo", "variety", "repeated_triples", "repeated_lines")
VALUES = (1, -1, 0)
#: Start and prior of P(vote | class), and the bound of P(bad vote | good document).
START = {"good": (0.92, 0.005, 0.075), "bad": (0.77, 0.17, 0.06)}
WRONG = 0.01

_BYTE = np.arange(256)
_SYMBOL = np.isin(_BYTE, np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_LOWER


class Seen:
    """What labellers and scorer look at, for the documents of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.docs = data, offsets, len(offsets) - 1
        start, end, before = bs.word_bounds(data, offsets)
        self.n = np.diff(before)
        self.row = np.repeat(np.arange(self.docs), self.n)
        self.words = bs.word_hashes(data, start, end)
        sums = lambda table: np.concatenate(([0], np.cumsum(table[data]))).astype(np.int64)
        within = lambda c: c[end] - c[start]
        symbol, upper, lower, mark, call = (sums(t) for t in (_SYMBOL, _UPPER, _LOWER, _MARK, _BYTE == 33))
        total = lambda c: c[offsets[1:]] - c[offsets[:-1]]
        self.symbols, self.marks, self.calls = total(symbol), total(mark), total(call)
        self.bytes = np.add.reduceat(np.append(end - start, 0), np.minimum(before[:-1], len(start))) * (self.n > 0)
        self.word_symbol = within(symbol) > 0
        self.word_caps = (within(upper) >= 2) & (within(lower) == 0)
        self.word_size = end - start
        self.echo = np.zeros(len(start), bool)
        if len(start):
            self.echo[1:] = (self.words[1:] == self.words[:-1]) & (self.row[1:] == self.row[:-1])
        at, own = bs.windows(before, 3)
        w = self.words
        triple = bs.mix(w[at] * bs.U64(3) + w[at + 1] * bs.U64(5) + w[at + 2] * bs.U64(7)) if len(at) else np.zeros(0, bs.U64)
        self.triples, self.triple_repeats = self._repeats(triple, own)
        self.kinds = self.n - self._repeats(w, self.row)[1]
        # Lines: hashes between line feeds.
        cut = np.flatnonzero(data == 10)
        edge = np.unique(np.concatenate((offsets[:-1], cut + 1, offsets[1:])))
        a, b = edge[:-1], edge[1:]
        solid = np.concatenate(([0], np.cumsum(~bs.IS_SPACE[data])))
        full = solid[b] > solid[a]
        a, b = a[full], b[full]
        line_row = np.searchsorted(offsets, a, "right") - 1
        trimmed = b - (data[b - 1] == 10) if len(b) else b
        self.lines, self.line_repeats = self._repeats(bs.Rolling(bs.BYTE_VALUES[0][data]).of(a, trimmed), line_row)

    def _repeats(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items by document, and those that equal an earlier one of it."""
        n = np.bincount(row, minlength=self.docs)
        h = bs.mix(hashes ^ bs.mix(row.astype(bs.U64), 5))
        order = np.argsort(h, kind="stable")
        same = np.concatenate(([False], h[order][1:] == h[order][:-1])) if len(h) else np.zeros(0, bool)
        return n, np.bincount(row[order][same], minlength=self.docs)

    def sum_by_row(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[mask], minlength=self.docs)

    def votes(self) -> np.ndarray:
        n = np.maximum(self.n, 1)
        size = np.maximum(self.bytes, 1)

        def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
            return np.where(bad, -1, np.where(good, 1, 0))

        caps, sym, echo = self.sum_by_row(self.word_caps) / n, self.sum_by_row(self.word_symbol) / n, self.sum_by_row(self.echo) / n
        triple = self.triple_repeats / np.maximum(self.triples, 1)
        line = self.line_repeats / np.maximum(self.lines, 1)
        variety = self.kinds / n
        out = [
            vote(self.n >= 20, self.n < 5),
            vote(self.symbols / n < 0.02, self.symbols / n > 0.1),
            vote(self.marks / size < 0.07, self.marks / size > 0.12),
            vote(sym < 0.05, sym > 0.25),
            vote(caps < 0.1, caps > 0.3),
            vote(self.calls / n < 0.03, self.calls / n > 0.2),
            vote(echo < 0.02, echo > 0.2),
            vote((variety > 0.4) | (self.n > 2000), (variety < 0.2) & (self.n < 2000)),
            vote(triple < 0.2, triple > 0.6),
            vote(line < 0.2, (line > 0.5) & (self.line_repeats >= 3)),
        ]
        return np.stack(out, 1).astype(np.int8)

    def events(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse hashed features as (row, dimension, value): log counts of word shapes, tails and repeats by document."""
        tail = np.minimum(self.word_size, 15)
        shape = self.word_caps * 1 + self.word_symbol * 2 + self.echo * 4
        codes = [bs.mix((shape * 16 + tail).astype(bs.U64), 31), bs.mix(shape.astype(bs.U64), 32), bs.mix(self.words, 33)]
        rows = [self.row] * 3
        once = np.arange(self.docs)
        n = np.maximum(self.n, 1)
        level = lambda x: np.minimum((10 * x).astype(np.int64), 10).astype(bs.U64)
        for k, x in enumerate((self.symbols / n, self.marks / np.maximum(self.bytes, 1) * 5, self.triple_repeats / np.maximum(self.triples, 1), self.line_repeats / np.maximum(self.lines, 1), self.calls / n, 1 - self.kinds / n)):
            codes.append(bs.mix(level(x), 40 + k))
            rows.append(once)
        row, code = np.concatenate(rows), (np.concatenate(codes) >> bs.U64(52)).astype(np.int64)
        key, count = np.unique(row * DIMS + code, return_counts=True)
        own, dim = key // DIMS, key % DIMS
        value = 1.0 + np.log(count)
        norm = np.sqrt(np.bincount(own, value * value, minlength=self.docs))
        return own, dim, value / norm[own]


def _posterior(votes: np.ndarray, prior: float, table: dict[str, np.ndarray]) -> np.ndarray:
    odds = np.log(table["good"] / table["bad"])
    at = np.select([votes == 1, votes == -1], [0, 1], 2)
    return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + odds[np.arange(votes.shape[1]), at].sum(1))))


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[float, dict[str, np.ndarray]]:
    """Expectation-maximisation over patterns of votes and their counts: share of good, P(vote | class) by labeller."""
    k, prior = len(LABELLERS), 0.85
    table = {y: np.tile(START[y], (k, 1)) for y in START}
    if n.sum() == 0:
        return prior, table
    pseudo = max(1.0, 0.02 * n.sum())
    for _ in range(rounds):
        good = _posterior(votes, prior, table)
        for y, part in (("good", good * n), ("bad", (1 - good) * n)):
            mass = np.stack([((votes == v) * part[:, None]).sum(0) for v in VALUES], 1) + pseudo * np.array(START[y])
            new = mass / mass.sum(1, keepdims=True)
            if y == "good":
                over = new[:, 1] > WRONG
                new[over] *= ((1 - WRONG) / (1 - new[over, 1]))[:, None]
                new[over, 1] = WRONG
            table[y] = new
        prior = float(np.clip((good * n).sum() / n.sum(), 0.5, 0.99))
    return prior, table


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels by gradient descent with momentum, both classes weighing alike."""
    row = np.repeat(np.arange(len(rows)), np.array([len(r[0]) for r in rows], int))
    dim = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, int)
    val = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    w, b = np.zeros(DIMS), 0.0
    if not len(labels):
        return w, b
    weight = labels / max(labels.sum(), 1e-9) + (1 - labels) / max((1 - labels).sum(), 1e-9)
    weight /= weight.sum()
    vw, vb = np.zeros(DIMS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, val * w[dim], minlength=len(rows)) + b)))
        g = (p - labels) * weight
        vw = 0.9 * vw - 8.0 * (np.bincount(dim, val * g[row], minlength=DIMS) + 1e-5 * w)
        vb = 0.9 * vb - 8.0 * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


class Model:
    def __init__(self, prior: float, table: dict[str, np.ndarray], w: np.ndarray, b: float) -> None:
        self.prior, self.table, self.w, self.b = prior, table, w, b


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Votes of all documents give the label model; at most `sample` documents, by hash, train the scorer."""
    text = docs.select(docs[text_col].alias("text"), docs[id_col].alias("id"))

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        for batch in batches:
            for _, _, data, offsets in bs.slices(batch.column(0)):
                kinds, n = np.unique(Seen(data, offsets).votes(), axis=0, return_counts=True)
                for kind, k in zip(kinds, n, strict=True):
                    sums[kind.tobytes()] = sums.get(kind.tobytes(), 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["votes", "n"])

    counts = text.select("text").mapInArrow(ballots, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).toArrow()
    n = counts["n"].to_numpy().astype(float)
    votes = np.frombuffer(b"".join(counts["votes"].to_pylist()), np.int8).reshape(len(n), len(LABELLERS))
    prior, table = estimate(votes, n)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in bs.slices(batch.column(0)):
                seen = Seen(data, offsets)
                own, dim, val = seen.events()
                edge = np.searchsorted(own, np.arange(seen.docs + 1)).astype(np.int32)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(edge), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([lists(dim, pa.int32()), lists(val, pa.float32()), pa.array(_posterior(seen.votes(), prior, table), pa.float64())], ["dim", "val", "good"])

    share = min(1.0, sample / max(1.0, n.sum()))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(29), "id", "text"), 1)
    few = text.where(h < F.lit(min((1 << 63) - 1, int(1.2 * share * 2**63)))).orderBy(h, "id").limit(sample)  # the same ones in every run
    got = few.select("text").mapInArrow(features, "dim array<int>, val array<float>, good double").toArrow()
    rows = [(np.array(d, np.int64), np.array(v, np.float64)) for d, v in zip(got["dim"].to_pylist(), got["val"].to_pylist(), strict=True)]
    return Model(prior, table, *_fit(rows, got["good"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (probability of good by the scorer), label (posterior of the votes), kept."""
    box = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = box.value
        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(1)):
                seen = Seen(data, offsets)
                own, dim, val = seen.events()
                p = 1 / (1 + np.exp(-(np.bincount(own, val * m.w[dim], minlength=seen.docs) + m.b)))
                p = np.where(seen.n > 0, p, 0.0)
                label = _posterior(seen.votes(), m.prior, m.table)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(p), pa.array(label), pa.array(p >= THRESHOLD)], ["doc_id", "score", "label", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(judge, f"doc_id {kind}, score double, label double, kept boolean")


def good_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns and no shuffle."""
    model = train(docs, id_col=id_col, text_col=text_col)
    box = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = box.value
        for batch in batches:
            mask = []
            for _, _, data, offsets in bs.slices(batch.column(at)):
                seen = Seen(data, offsets)
                own, dim, val = seen.events()
                p = 1 / (1 + np.exp(-(np.bincount(own, val * m.w[dim], minlength=seen.docs) + m.b)))
                mask.append((p >= THRESHOLD) & (seen.n > 0))
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(keep, docs.schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))
