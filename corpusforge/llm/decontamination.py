"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of a few blocks of words. Document frequencies of hashed words give TF-IDF weights; a
distributed randomised singular value decomposition (one sketch pass over all passages, partial products summed by cell)
gives a latent basis, scaled so that frequent directions don't drown the rest. Every passage is compared by cosine with
every benchmark item in blocks of the stated query set, and candidates are confirmed by the longest common subsequence
of words; a paraphrase must also hold the item's answer, its last third.

Before the subsequence, a passage's surroundings must hold so many of an item's telling words (its rarest, by rank) as a
subsequence of the asked length can't do without. That bound loses no match whatever the frequencies are, and copies
close enough to count as verbatim need no cosine: only paraphrases depend on the latent space.

The model has DIMS x RANK numbers whatever the corpus; text never shuffles. Defined results: null and empty texts and
items match nothing; items of fewer than MIN_ITEM words match where all their words stand in one piece; characters of
three bytes or more (Chinese, Japanese, Thai) are words of their own; repeated rows are judged alike; equal scores name the least item; an empty corpus or benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs

DIMS, RANK = 1 << 12, 32
SLICE = 256 << 10  # bytes looked at together: the arrays of a slice fit a cache
BLOCK, BLOCKS = 12, 3  # words in a block, blocks in a passage
COSINE = 0.42
TELLING = 0.6  # an item's rarest words, of at least that share of its length, tell whether a passage may hold it
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.65, 0.6  # shares of words in the common subsequence
MIN_ITEM = 8
ITEM_BLOCK = 512
MAX_ITEM_BYTES = 8 << 20  # of one pass, whose lists and masks take some 20 times that; a larger benchmark takes several passes
#: Letters fold to lower case, longer characters stay, everything else parts words.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def _bounds(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as bs.word_bounds has them, parted around each character of three bytes or more."""
    start, end, before = bs.word_bounds(folded, offsets)
    wide = folded >= 0xE0
    if not wide.any():
        return start, end, before
    char = np.flatnonzero((folded & 0xC0) != 0x80)
    after = char[1:][wide[char[:-1]]]
    parts = np.union1d(start, np.concatenate((np.flatnonzero(wide), after[folded[after] != 32])))
    end = np.minimum(end[np.searchsorted(start, parts, "right") - 1], np.append(parts[1:], len(folded)))
    return parts, end, np.searchsorted(parts, offsets)


class Tokens:
    """Word hashes of one slice, their dimensions, and the blocks they fall in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        folded = FOLD[data]
        start, end, self.before = _bounds(folded, offsets)
        self.words = bs.word_hashes(folded, start, end)
        self.dim = (self.words >> bs.U64(52)).astype(np.int64)
        n = np.diff(self.before)
        blocks = -(-n // BLOCK)
        self.block_row = np.repeat(np.arange(len(n)), blocks)
        number = bs.spread(np.zeros(len(n), np.int64), blocks)
        self.block_at = self.before[:-1][self.block_row] + number * BLOCK
        # A passage starts at each block that has enough blocks after it, and at the first of every document.
        self.passage = np.flatnonzero((number == 0) | (number + BLOCKS <= blocks[self.block_row]))
        self.passage_end = np.minimum(self.passage + BLOCKS, np.cumsum(blocks)[self.block_row[self.passage]])
        self.row = self.block_row[self.passage]

    def block(self) -> np.ndarray:
        """The block of each word."""
        return np.repeat(np.arange(len(self.block_at)), np.diff(np.append(self.block_at, len(self.words))))

    def passages(self, table: np.ndarray) -> np.ndarray:
        """Sums of table[dim] over each passage."""
        if not len(self.words):
            return np.zeros((0, table.shape[1]), table.dtype)
        # Word by word of all blocks, which keeps the sums in the cache; places that a short block lacks point to a row of zeros.
        place = np.full((len(self.block_at), BLOCK), DIMS)
        block = self.block()
        place[block, np.arange(len(block)) - self.block_at[block]] = self.dim
        padded = np.concatenate((table, np.zeros_like(table[:1])))
        sums = padded[place[:, 0]]
        for i in range(1, BLOCK):
            sums += padded[place[:, i]]
        sums = np.concatenate((np.zeros_like(sums[:1]), np.cumsum(sums, axis=0, dtype=np.float64)))
        return (sums[self.passage_end] - sums[self.passage]).astype(np.float32)

    def spread_back(self, value: np.ndarray) -> np.ndarray:
        """For each dimension the sum of value over the passages that its words lie in (words count by occurrence)."""
        step = np.zeros((len(self.block_at) + 1, value.shape[1]))
        step[self.passage] += value  # starts and ends are distinct
        step[self.passage_end] -= value
        by_block, block = np.ascontiguousarray(np.cumsum(step, axis=0)[:-1].T), self.block()
        return np.stack([np.bincount(self.dim, column[block], DIMS) for column in by_block], 1)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.float64())], ["cell", "value"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sums by cell over all tasks; size is DIMS x RANK at most, so the result fits the driver."""
    got = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[got["cell"].to_numpy()] = got["value"].to_numpy()
    return out


def latent_basis(text: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis): the basis already holds the weights, so a passage's vector is the sum of its words' rows."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1)
        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(0), SLICE):
                t = Tokens(data, offsets)
                # Long documents fill most dimensions, so frequencies count the blocks and not the documents.
                held = np.sort(t.block() * DIMS + t.dim)
                total[:DIMS] += np.bincount(held[np.append(True, held[1:] != held[:-1])[: len(held)]] % DIMS, minlength=DIMS)
                total[DIMS] += len(t.block_at)
        yield _cells(total)

    found = _summed(text.mapInArrow(frequencies, "cell int, value double"), DIMS + 1)
    idf = np.log((found[DIMS] + 1) / (found[:DIMS] + 1)) + 0.05
    probe = np.random.default_rng(5).standard_normal((DIMS, RANK)).astype(np.float32)
    weight = (idf[:, None] * probe).astype(np.float32)
    square = (idf**2)[:, None].astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS, RANK))
        for batch in batches:
            for _, _, data, offsets in bs.slices(batch.column(0), SLICE):
                t = Tokens(data, offsets)
                if len(t.words):
                    norm = np.maximum(t.passages(square), 1e-9)
                    total += t.spread_back(t.passages(weight) / norm)
        yield _cells((total * idf[:, None]).ravel())

    product = _summed(text.mapInArrow(sketch, "cell int, value double"), DIMS * RANK).reshape(DIMS, RANK)
    return idf, (idf[:, None] * whitened(product, probe)).astype(np.float32)


def whitened(product: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Leading eigenvectors of A'A over their singular values, from the one-pass sketch product = A'A @ probe.

    The sketch of a positive matrix gives its Nystrom form product (probe' product)^-1 product'; a small shift keeps the
    core invertible. Directions that the sketch holds no mass in are left at zero.
    """
    probe = probe.astype(np.float64)
    shift = 1e-9 * max(float(np.linalg.norm(product)), 1e-9)
    core = probe.T @ (product + shift * probe)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    safe = values > 1e-10 * max(float(values.max(initial=0.0)), 1e-300)
    half = (product + shift * probe) @ (vectors[:, safe] / np.sqrt(values[safe]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    out = np.zeros((product.shape[0], probe.shape[1]))
    used = s > 1e-4 * max(float(s.max(initial=0.0)), 1e-12)
    out[:, : used.sum()] = u[:, used] / s[used]
    return out


def _lcs(item: list[int], masks: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    full = (1 << len(item)) - 1
    v = full
    for x in text:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _masks(item: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(item):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _least(share: float, n: int) -> int:
    """The least length of a subsequence that is `share` of n words."""
    return next(k for k in range(int(share * n), n + 1) if k / n >= share)


class Items:
    """The benchmark items of one pass: latent vectors, words as numbers of a common vocabulary, weights."""

    def __init__(self, ids: list[int], texts: list[bytes], idf: np.ndarray, basis: np.ndarray) -> None:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        t = Tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
        n = np.diff(t.before)
        keep = np.flatnonzero(n >= MIN_ITEM)
        short = np.flatnonzero((n > 0) & (n < MIN_ITEM))
        self.vocabulary, number = np.unique(t.words, return_inverse=True)
        self.weight = np.zeros(len(self.vocabulary) + 1, np.float32)
        self.weight[number] = idf[t.dim]
        self.ids = [ids[i] for i in [*keep, *short]]
        self.words = [number[t.before[i] : t.before[i + 1]].tolist() for i in keep]
        # Short items by length: word sequence -> numbers of the items.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for g, i in enumerate(short, len(keep)):
            self.short.setdefault(int(n[i]), {}).setdefault(tuple(number[t.before[i] : t.before[i + 1]].tolist()), []).append(g)
        rows = [basis[t.dim[t.before[i] : t.before[i + 1]]].sum(0) for i in keep]
        vectors = np.stack(rows) if rows else np.zeros((0, RANK), np.float32)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        self.basis = basis
        self.masks = [_masks(w) for w in self.words]
        self.telling, self.need = self._tell()
        self.tails = [w[-max(3, len(w) // 3) :] for w in self.words]
        self.tail_masks = [_masks(w) for w in self.tails]

    def _tell(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each item its telling words, and how many of their occurrences a paraphrase and a verbatim copy need.

        A subsequence of so many of the item's words misses the rest at most, even if all that it misses are telling.
        """
        telling, need = [], np.zeros((len(self.words), 2), np.int64)
        for i, w in enumerate(self.words):
            word, n = np.unique(w, return_counts=True)
            order = np.argsort(-self.weight[word], kind="stable")
            held = np.cumsum(n[order])
            k = int(np.searchsorted(held, TELLING * len(w))) + 1
            telling.append(word[order[:k]])
            need[i] = [held[k - 1] - (len(w) - _least(share, len(w))) for share in (PARAPHRASE, VERBATIM)]
        return telling, need

    def _tellings(self, t: Tokens, number: np.ndarray, some: range, reach: np.ndarray) -> np.ndarray:
        """Passages x items: how often a passage and `reach` blocks to each side have a telling word of the item."""
        word = np.concatenate([self.telling[j] for j in some])
        item = np.repeat(np.arange(len(some)), [len(self.telling[j]) for j in some])
        order = np.argsort(word, kind="stable")
        item, first = item[order], np.searchsorted(word[order], np.arange(len(self.vocabulary) + 2))
        n = np.diff(first)
        use = np.flatnonzero(n[number])
        each = n[number[use]]
        cell = np.repeat(t.block()[use], each) * len(some) + item[bs.spread(first[number[use]], each)]
        by_block = np.bincount(cell, minlength=len(t.block_at) * len(some)).reshape(len(t.block_at), len(some))
        # Running sums may wrap around; their differences don't, since a number holds all words of the widest surroundings.
        kind = np.int16 if (2 * int(reach.max()) + BLOCKS) * BLOCK < 1 << 15 else np.int64
        sums = np.zeros((len(by_block) + 1, len(some)), kind)
        np.cumsum(by_block.astype(kind), axis=0, dtype=kind, out=sums[1:])
        out = np.empty((len(t.passage), len(some)), kind)
        low, high = np.searchsorted(t.block_row, t.row), np.searchsorted(t.block_row, t.row, "right")
        for r in np.unique(reach):
            at = np.flatnonzero(reach == r)
            mine = np.ascontiguousarray(sums[:, at])
            out[:, at] = mine[np.minimum(t.passage_end + r, high)] - mine[np.maximum(t.passage - r, low)]
        return out

    def _whole(self, t: Tokens, number: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) where all words of a short item stand in one piece."""
        found: set[tuple[int, int]] = set()
        for size, items in self.short.items():
            at, row = bs.windows(t.before, size)
            firsts = np.zeros(len(self.vocabulary) + 1, bool)
            lasts = firsts.copy()
            firsts[[w[0] for w in items]] = True
            lasts[[w[-1] for w in items]] = True
            for k in np.flatnonzero(firsts[number[at]] & lasts[number[at + size - 1]]):
                found.update((int(row[k]), g) for g in items.get(tuple(number[at[k] : at[k] + size].tolist()), ()))
        return found

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, item, share of the item's words in the common subsequence) for each confirmed pair."""
        t = Tokens(data, offsets)
        if not len(t.words) or not self.ids:
            return []
        latent = t.passages(self.basis)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        place = np.minimum(np.searchsorted(self.vocabulary, t.words), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[place] == t.words, place, len(self.vocabulary)).astype(np.int64)
        begin = t.block_at[t.passage]
        stop = np.append(t.block_at, len(t.words))[t.passage_end]
        stop = np.where(t.passage_end < len(t.block_at), stop, len(t.words))
        best = dict.fromkeys(self._whole(t, number), 1.0)
        for lo in range(0, len(self.words), ITEM_BLOCK):
            some = range(lo, min(lo + ITEM_BLOCK, len(self.words)))
            size = np.array([len(self.words[j]) for j in some])
            need = np.array([_least(PARAPHRASE, n) for n in size])
            width = len(self.vocabulary) + 1
            cell = np.repeat(np.arange(len(some)) * width, size) + np.concatenate([self.words[j] for j in some])
            count = np.bincount(cell, minlength=len(some) * width).astype(np.int32).reshape(len(some), width)
            held = count > 0
            telling = self._tellings(t, number, some, -(-size // BLOCK))
            enough, verbatim = self.need[lo : some.stop].T.astype(telling.dtype)
            reach = int(size.max())
            padded = np.concatenate((np.full(reach, len(self.vocabulary)), number, np.full(reach + BLOCK * BLOCKS, len(self.vocabulary))))
            for p0 in range(0, len(latent), 8192):
                near = latent[p0 : p0 + 8192] @ self.vectors[lo : some.stop].T >= COSINE
                told = telling[p0 : p0 + 8192]
                passage, item = np.nonzero((near & (told >= enough)) | (told >= verbatim))
                passage += p0
                # The words of the item that the passage and its surroundings hold, before any subsequence.
                for c0 in range(0, len(passage), 20000):
                    p, j = passage[c0 : c0 + 20000], item[c0 : c0 + 20000]
                    near = padded[begin[p][:, None] + np.arange(2 * reach + BLOCK * BLOCKS)[None, :]]
                    near = np.where(held[j[:, None], near], near, len(self.vocabulary))
                    near.sort(axis=1)
                    fresh = np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
                    mass = (count[j[:, None], near] * fresh).sum(1)
                    for k in np.flatnonzero(mass >= need[j]):
                        row, g = int(t.row[p[k]]), lo + int(j[k])
                        if best.get((row, g), 0.0) >= 1.0:
                            continue
                        w = self.words[g]
                        a = max(int(t.before[row]), int(begin[p[k]]) - len(w))
                        b = min(int(t.before[row + 1]), int(stop[p[k]]) + len(w))
                        text = [x for x in number[a:b].tolist() if held[g - lo, x]]
                        share = _lcs(w, self.masks[g], text) / len(w)
                        if share >= PARAPHRASE and (share >= VERBATIM or _lcs(self.tails[g], self.tail_masks[g], text) >= ANSWER * len(self.tails[g])):
                            best[row, g] = max(share, best.get((row, g), 0.0))
        return [(row, g, share) for (row, g), share in best.items()]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, idf: np.ndarray, basis: np.ndarray) -> Iterator[Items]:
    """The benchmark as broadcastable parts: each of a checked size."""
    ids, texts, held = [], [], 0
    for row in benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i").toLocalIterator():
        text = row["t"].encode()
        if held and held + len(text) > MAX_ITEM_BYTES:
            yield Items(ids, texts, idf, basis)
            ids, texts, held = [], [], 0
        ids.append(row["i"])
        texts.append(text)
        held += len(text)
    yield Items(ids, texts, idf, basis)


def _hits(items: Items, column: pa.Array, item: list, share: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Number of items, best item and best share by row of the batch, given the best ones so far."""
    n, share = np.zeros(len(column), np.int64), share.copy()
    for a, _, data, offsets in bs.slices(column, SLICE):
        for row, g, value in items.matches(data, offsets):
            r = a + row
            n[r] += 1
            if value > share[r] or (value == share[r] and (item[r] is None or items.ids[g] < item[r])):
                share[r], item[r] = value, items.ids[g]
    return n, item, share


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_id (the best match) and share."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    idf, basis = latent_basis(text.select("text"))
    # Each part of the benchmark is a pass over the same rows that adds to what the ones before found.
    out = text.withColumns({"n_items": F.lit(0).cast("long"), "item_id": F.lit(None).cast("long"), "share": F.lit(0.0)})
    names = ["doc_id", "text", "n_items", "item_id", "share"]
    for items in _passes(benchmark, item_col, item_text_col, idf, basis):
        box = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, item, share = _hits(box.value, batch.column(1), batch.column(3).to_pylist(), np.array(batch.column(4), float))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.asarray(batch.column(2)) + n), pa.array(item, pa.int64()), pa.array(share)], names)

        out = out.mapInArrow(scan, f"doc_id {kind}, text string, n_items long, item_id long, share double")
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "share")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that match no item, with all their columns and no shuffle."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    idf, basis = latent_basis(docs.select(docs[text_col].alias("text")))
    out = docs
    for items in _passes(benchmark, item_col, item_text_col, idf, basis):
        box = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_hits(box.value, batch.column(at), [None] * batch.num_rows, np.zeros(batch.num_rows))[0] == 0, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
