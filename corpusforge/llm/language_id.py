"""Language identification by multilingual mixture inference.

A language is a smoothed distribution over hashed byte trigrams of case-folded text. A document is cut into segments of
a few words; expectation-maximisation over their likelihoods estimates the share of each language in the document, and
the set of languages grows by the next likeliest one while the penalised likelihood improves. Counting and inference are single passes without a
shuffle of text; the model has languages x BUCKETS numbers whatever the corpus.

Defined results: a null text, or one without a letter, is `und` with score 0; a table without labelled rows predicts
`und` for all, and `und` has no languages; rows without a language aren't learnt from but are predicted; ties go to the
first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs

BUCKETS = 1 << 15
SEGMENT = 4  # words
MAX_LANGUAGES = 1000  # an error beyond it, never a cut: the model must fit an executor
PENALTY = 2.0  # times log(segments) for each language more
UND = "und"
#: Letters and bytes of longer characters stay; other ASCII turns into space, so marks and digits say nothing.
FOLD = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 32).astype(np.uint8)
FOLD[65:91] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams, one at each byte but those that would be all space, and their places."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = FOLD[data]
    after = np.concatenate(([0], data[:-1])) == 0xC3
    x = np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), x + 32, x).astype(np.uint32)
    edge = np.zeros(len(x) + 2, bool)
    edge[offsets[1:]] = True
    nxt = np.append(x[1:], 32)
    nxt[edge[1 : len(x) + 1]] = 32  # the last byte of a document is followed by space
    third = np.append(nxt[1:], 32)
    third[edge[1 : len(x) + 1]] = 32
    code = (x << 16) | (nxt << 8) | third
    keep = np.flatnonzero((x != 32) | (nxt != 32))
    return ((code[keep].astype(np.uint64) * bs.U64(0x9E3779B97F4A7C15)) >> bs.U64(49)).astype(np.int64), keep


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(text, lang) -> the languages in order and the log-probabilities, shape (BUCKETS, languages)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            text, lang = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=object)
            for a, b, data, offsets in bs.slices(text):
                code, at = trigrams(data, offsets)
                row = np.searchsorted(offsets, at, "right") - 1
                names, own = np.unique(lang[a:b].astype(str), return_inverse=True)
                table = np.bincount(own[row] * BUCKETS + code, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, line in zip(names, table, strict=True):
                    sums[name] = sums.get(name, 0) + line
        for name, line in sums.items():
            used = np.flatnonzero(line)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(line[used], pa.int64())], ["lang", "bucket", "n"])

    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} are supported")
    at = {name: i for i, name in enumerate(names)}
    dense = np.full((BUCKETS, len(names)), 0.5)
    if names:
        np.add.at(dense, (table["bucket"].to_numpy(), np.array([at[x] for x in table["lang"].to_pylist()])), table["n"].to_numpy())
        dense = np.log(dense / dense.sum(0))
    return names, dense.astype(np.float32)


def mixture(likely: np.ndarray, start: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares by document and the log-likelihood; likely: segments x languages, scaled to a largest value of 1."""
    share = allowed / allowed.sum(1, keepdims=True)
    row = np.repeat(np.arange(len(n)), n)
    for _ in range(rounds):
        part = likely * share[row]
        total = np.maximum(part.sum(1), 1e-30)
        share = np.add.reduceat(part / total[:, None], start, axis=0) / n[:, None]
    total = np.maximum((likely * share[row]).sum(1), 1e-30)
    return share, np.add.reduceat(np.log(total), start)


def infer(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document the best language (-1: none), its share in the best set of languages, and the shares of all.

    The shares (documents x languages) are 0 outside the set.
    """
    docs, k = len(offsets) - 1, model.shape[1]
    best, score, shares = np.full(docs, -1), np.zeros(docs), np.zeros((docs, k))
    code, at = trigrams(data, offsets)
    if k == 0 or len(code) == 0:
        return best, score, shares
    first, _, before = bs.word_bounds(data, offsets)
    # A segment starts at every SEGMENT-th word of a document.
    number = np.arange(len(first)) - np.repeat(before[:-1], np.diff(before))
    starts = first[number % SEGMENT == 0]
    edge = np.searchsorted(at, starts)
    edge = edge[np.diff(np.append(edge, len(at))) > 0]  # segments without a trigram say nothing
    owner = np.searchsorted(offsets, at[edge], "right") - 1
    log = np.add.reduceat(model[code], edge, axis=0).astype(np.float64)
    likely = np.exp(log - log.max(1, keepdims=True))
    used, start, n = np.unique(owner, return_index=True, return_counts=True)
    share, _ = mixture(likely, start, n, np.ones((len(used), k)), 5)
    order = np.argsort(-share, axis=1, kind="stable")
    top, found = np.full(len(used), -np.inf), np.zeros((len(used), k))
    live = np.arange(len(used))  # documents whose set still grows, each judged by itself
    for size in range(1, k + 1):
        allowed = np.zeros((len(live), k))
        np.put_along_axis(allowed, order[live, :size], 1.0, 1)
        mine = np.zeros(len(used), bool)
        mine[live] = True
        part, fit = mixture(likely[np.repeat(mine, n)], np.cumsum(n[live]) - n[live], n[live], allowed, 0 if size == 1 else 4)
        fit = fit - PENALTY * size * np.log(n[live] + 1)
        better = fit > top[live]
        live, part, fit = live[better], part[better], fit[better]
        if not len(live):
            break
        top[live], found[live] = fit, part
    shares[used] = np.clip(found, 0.0, 1.0)
    best[used] = found.argmax(1)
    score[used] = shares[used].max(1)
    return best, score, shares


def identify(docs: DataFrame, names: list[str], model: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, langs and shares (the document's languages, the largest share first)."""
    box = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MAX_LANGUAGES numbers at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*names, UND], dtype=object)
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in bs.slices(batch.column(1)):
                best, score, shares = infer(data, offsets, box.value)
                best, shares = np.where(lettered[a:b], best, -1), shares * lettered[a:b, None]
                row, lang = np.nonzero(shares)
                order = np.lexsort((lang, -shares[row, lang], row))
                row, lang = row[order], lang[order]
                edge = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, x) for x in (pa.array(labels[lang], pa.string()), pa.array(shares[row, lang], pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(labels[best], pa.string()), pa.array(np.where(best < 0, 0.0, score), pa.float64()), *lists], ["doc_id", "lang_pred", "score", "langs", "shares"])

    kind = docs.schema[id_col].dataType.simpleString()
    letters = F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False))
    columns = f"doc_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), letters.alias("lettered")).mapInArrow(predict, columns)


def held_out(ident) -> F.Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, model = learn(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    return identify(docs, names, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs", "shares")
