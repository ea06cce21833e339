"""Byte-pair vocabularies: training, encoding, eligibility, closure, selection, reachability, remapping.

Counting runs on the cluster: pieces, their frequencies, pairs. Training holds a bounded number of pieces on the driver;
beyond it the executors count for it.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.functions import numeric, text
from corpusforge.sources import scratch

Merge = tuple[str, str]
Flat = tuple[np.ndarray, np.ndarray]
#: Pieces that the driver trains on by itself, pieces it guesses from, merges it guesses at once, pieces of a block.
MAX_PIECES, GUESS_PIECES, GUESS_MERGES, BLOCK_PIECES = 200_000, 100_000, 64, 100_000
#: Rows that a task numbers, or words whose prefixes it counts.
RANGE_ROWS = 500_000


def piece_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """piece, n: frequency of the pre-tokens."""
    return docs.select(F.explode(text.pretokens(docs[text_col])).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """left, right, n: adjacent byte pairs within pieces, weighted by the pieces' frequency."""
    digits = F.regexp_extract_all(F.hex(F.encode("piece", "UTF-8")), F.lit(".."), F.lit(0))
    both = F.zip_with(F.slice(digits, F.lit(1), F.greatest(F.size(digits) - 1, F.lit(0))), F.slice(digits, F.lit(2), F.greatest(F.size(digits) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return pieces.select("n", F.explode(both).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def byte_alphabet() -> dict[int, str]:
    """The public byte-to-character map: printable Latin-1 bytes stay, the rest count up from 256."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


def train(counts: list[tuple[str, int]], vocab_size: int, min_count: int = 2) -> tuple[dict[str, int], list[Merge]]:
    """(vocabulary, merges) from piece counts. The most frequent pair merges, of equal ones that of the least ids."""
    alphabet = byte_alphabet()
    names = sorted(alphabet.values())
    ids = {c: i for i, c in enumerate(names)}
    words = [[ids[alphabet[b]] for b in piece.encode()] for piece, _ in counts]
    weight = [n for _, n in counts]
    total: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for w, (word, n) in enumerate(zip(words, weight, strict=True)):
        for pair in zip(word, word[1:]):
            total[pair] += n
            where[pair].add(w)
    heap = [(-n, pair) for pair, n in total.items()]
    heapq.heapify(heap)
    merges: list[Merge] = []
    while heap and len(names) < vocab_size:
        n, pair = heapq.heappop(heap)
        if -n != total.get(pair, 0):
            if total.get(pair, 0) > 0:
                heapq.heappush(heap, (-total[pair], pair))
            continue
        if -n < min_count:
            break
        new = len(names)
        names.append(names[pair[0]] + names[pair[1]])
        merges.append((names[pair[0]], names[pair[1]]))
        changed: set[tuple[int, int]] = set()
        for w in where.pop(pair):
            word, i, out = words[w], 0, []
            while i < len(word):
                if i + 1 < len(word) and (word[i], word[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            for p in zip(word, word[1:]):
                total[p] -= weight[w]
                changed.add(p)
            for p in zip(out, out[1:]):
                total[p] += weight[w]
                where[p].add(w)
                changed.add(p)
            words[w] = out
        total.pop(pair, None)
        for p in changed:
            if total.get(p, 0) > 0:
                heapq.heappush(heap, (-total[p], p))
    vocab: dict[str, int] = {}
    for i, name in enumerate(names):
        vocab.setdefault(name, i)
    return vocab, merges


def _byte_ids() -> tuple[list[str], np.ndarray]:
    """The names of the first 256 ids, and the id of each byte."""
    alphabet = byte_alphabet()
    names = sorted(alphabet.values())
    place = {c: i for i, c in enumerate(names)}
    return names, np.array([place[alphabet[b]] for b in range(256)], np.int32)


def _flat(pieces: list[str], weights: list[int]) -> Flat:
    """Symbols of all pieces one after another, -1 after each, and the pieces' weights."""
    body = [x.encode() for x in pieces]
    sizes = np.fromiter((len(x) + 1 for x in body), np.int64, len(body))
    symbols = _byte_ids()[1][np.frombuffer(b"".join(x + b"\0" for x in body), np.uint8)]
    symbols[np.cumsum(sizes) - 1] = -1
    return symbols, np.asarray(weights, np.int64)


def _hits(s: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    return np.flatnonzero((s[:-1] == pair[0]) & (s[1:] == pair[1]))


def _merged(s: np.ndarray, pair: tuple[int, int], new: int, at: np.ndarray) -> np.ndarray:
    """The pair's occurrences at the given places become the new symbol, from left to right."""
    if pair[0] == pair[1] and len(at):  # of a run of equal symbols every other place
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) != 1
        start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
    if not len(at):
        return s
    stay = np.ones(len(s), bool)
    stay[at + 1] = False
    s = s.copy()
    s[at] = new
    return s[stay]


def _merge_all(s: np.ndarray, made: list[tuple[int, int]], first: int) -> np.ndarray:
    for i, pair in enumerate(made):
        s = _merged(s, pair, first + i, _hits(s, pair))
    return s


def _sums(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(len(code), 1), bool), code[1:] != code[:-1])))
    return code[start], np.add.reduceat(n, start) if len(start) else n


def _pairs(s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (left << 32 | right) of the adjacent pairs and the weight of each, an entry for each occurrence."""
    each = np.repeat(w, np.diff(np.flatnonzero(s < 0), prepend=-1))
    both = (s[:-1] >= 0) & (s[1:] >= 0)
    return (s[:-1][both].astype(np.int64) << 32) | s[1:][both], each[:-1][both]


def _change(s: np.ndarray, w: np.ndarray, pair: tuple[int, int], new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged symbols, and by how much the pairs' weights change: only pieces that hold the pair are counted."""
    hit = _hits(s, pair)
    if not len(hit):
        return s, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(s < 0)
    piece = np.unique(np.searchsorted(ends, hit))
    lo = np.where(piece > 0, ends[piece - 1] + 1, 0)
    n = ends[piece] + 1 - lo
    part = s[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    old, now = _pairs(part, w[piece]), _pairs(_merged(part, pair, new, _hits(part, pair)), w[piece])
    code, total = _sums(np.concatenate((old[0], now[0])), np.concatenate((-old[1], now[1])))
    return _merged(s, pair, new, hit), code[total != 0], total[total != 0]


def _best(total: dict[int, int]) -> tuple[int, tuple[int, int]]:
    """(weight, pair) to merge next: the heaviest, of equal ones that of the least ids."""
    n = max(total.values(), default=0)
    code = min((c for c, x in total.items() if x == n), default=0)
    return n, (code >> 32, code & 0xFFFFFFFF)


def _add(total: dict[int, int], codes: Iterable[int], change: Iterable[int]) -> None:
    for c, d in zip(codes, change, strict=True):
        n = total.get(c, 0) + d
        if n:
            total[c] = n
        else:
            total.pop(c, None)


def _guess(sample: Flat, total: dict[int, int], first: int, most: int) -> list[tuple[int, int]]:
    """The next merges by the exact weights of now and the changes that the sample lets expect; the first is certain."""
    (s, w), total, made = sample, dict(total), []
    while len(made) < most:
        n, pair = _best(total)
        if n <= 0:
            break
        s, codes, change = _change(s, w, pair, first + len(made))
        made.append(pair)
        _add(total, codes.tolist(), change.tolist())
        total.pop((pair[0] << 32) | pair[1], None)
    return made


def train_spread(pieces: DataFrame, vocab_size: int, min_count: int = 2) -> tuple[dict[str, int], list[Merge]]:
    """train() where the pieces (piece, n) are too many for the driver: they stay on the executors in packed blocks.

    The driver holds a bounded sample to guess the next merges; executors carry the guess out on all pieces and report
    how each merge changes the pairs' weights. A guessed merge stands only if it is the best by these exact weights, and
    the next round guesses on from the last that stands, so a bad guess costs time and nothing else.
    """
    names = _byte_ids()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = [], []
        for batch in batches:
            words += batch["piece"].to_pylist()
            weights += batch["n"].to_pylist()
            if len(words) >= BLOCK_PIECES:
                yield block(*_flat(words, weights))
                words, weights = [], []
        if words:
            yield block(*_flat(words, weights))

    def block(s: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["symbols", "weights"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Flat]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield np.frombuffer(batch["symbols"][row].as_buffer(), np.int32), np.frombuffer(batch["weights"][row].as_buffer(), np.int64)

    def moved(blocks: DataFrame, made: list[tuple[int, int]], first: int) -> DataFrame:
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, w in read(batches):
                yield block(_merge_all(s, made, first), w)

        out = scratch.cut(blocks.mapInArrow(move, "symbols binary, weights binary"), "piece-blocks")
        scratch.forget(blocks)
        return out

    def changes(blocks: DataFrame, done: list[tuple[int, int]], guessed: list[tuple[int, int]], first: int, whole: bool) -> list[dict[int, int]]:
        """The changes that each guessed merge brings after those done; with whole, the weights before them first."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, w in read(batches):
                s = _merge_all(s, done, first)
                steps = [(0, *_sums(*_pairs(s, w)))] if whole else []
                for i, pair in enumerate(guessed):
                    s, code, n = _change(s, w, pair, first + len(done) + i)
                    steps.append((i + 1, code, n))
                step = np.repeat(np.array([i for i, _, _ in steps], np.int32), [len(c) for _, c, _ in steps])
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(np.concatenate([c for _, c, _ in steps])), pa.array(np.concatenate([n for _, _, n in steps]))], ["step", "code", "n"])

        found = blocks.mapInArrow(count, "step int, code long, n long").groupBy("step", "code").agg(F.sum("n").alias("n")).where("n <> 0").toArrow()
        out: list[dict[int, int]] = [{} for _ in range(len(guessed) + 1)]
        for i, code, n in zip(found["step"].to_pylist(), found["code"].to_pylist(), found["n"].to_pylist(), strict=True):
            out[i][code] = n
        return out

    count = pieces.count()
    top = pieces.orderBy(F.desc("n"), "piece").limit(GUESS_PIECES // 2).toArrow()
    every = max(1, 2 * count // GUESS_PIECES)  # one piece of so many stands for the others
    rest = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(every)) == 0).limit(GUESS_PIECES).toArrow()
    weight = dict(zip(rest["piece"].to_pylist(), [n * every for n in rest["n"].to_pylist()], strict=True)) | dict(zip(top["piece"].to_pylist(), top["n"].to_pylist(), strict=True))
    sample = _flat(list(weight), list(weight.values()))
    blocks = scratch.cut(pieces.select("piece", "n").mapInArrow(pack, "symbols binary, weights binary"), "piece-blocks")
    total = changes(blocks, [], [], 256, True)[0]
    known: list[tuple[int, int]] = []
    base = 0  # merges that the blocks hold already
    while len(names) + len(known) < vocab_size and _best(total)[0] >= min_count:
        if len(known) - base >= GUESS_MERGES:
            blocks, base = moved(blocks, known[base:], 256 + base), len(known)
        first = 256 + len(known)
        guessed = _guess(sample, total, first, min(GUESS_MERGES, vocab_size - len(names) - len(known)))
        found = changes(blocks, known[base:], guessed, 256 + base, False)
        for pair, change in zip(guessed, found[1:], strict=True):
            n, best = _best(total)
            if n < min_count or pair != best:
                break
            sample = _merged(sample[0], pair, 256 + len(known), _hits(sample[0], pair)), sample[1]
            known.append(pair)
            _add(total, change.keys(), change.values())
    scratch.forget(blocks)
    merges: list[Merge] = []
    for a, b in known:
        merges.append((names[a], names[b]))
        names.append(names[a] + names[b])
    vocab: dict[str, int] = {}
    for i, name in enumerate(names):
        vocab.setdefault(name, i)
    return vocab, merges


def train_on(docs: DataFrame, vocab_size: int, text_col: str = "text") -> tuple[dict[str, int], list[Merge]]:
    """Training on every distinct piece: on the driver up to MAX_PIECES, beyond that on the executors, with equal results."""
    pieces = scratch.cut(piece_counts(docs, text_col), "pieces")
    if pieces.count() > MAX_PIECES:
        made = train_spread(pieces, vocab_size)
    else:
        rows = pieces.toArrow().sort_by([("n", "descending"), ("piece", "ascending")])
        made = train(list(zip(rows["piece"].to_pylist(), rows["n"].to_pylist(), strict=True)), vocab_size)
    scratch.forget(pieces)
    return made


def encoder(vocab: dict[str, int], merges: list[Merge]):
    """A pandas UDF text -> ids; the tokenizer is built once for each Python worker."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        tok = Tokenizer(BPE(vocab=vocab, merges=merges))
        pattern = text.PRETOKEN.removeprefix("(?U)")
        tok.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
        for s in batches:
            texts = s.fillna("").tolist()  # an encoding takes many times its text, so few are held at once
            yield pd.Series([np.array(e.ids, np.int32) for a in range(0, len(texts), 64) for e in tok.encode_batch(texts[a : a + 64], add_special_tokens=False)])

    return encode


def decoder(vocab: dict[str, int]):
    back = {c: b for b, c in byte_alphabet().items()}
    pieces = {i: bytes(back[c] for c in t) for t, i in vocab.items()}

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda ids: b"".join(pieces[i] for i in ids).decode("utf-8", "replace"))

    return decode


def eligible(token: Column, protected: Column, dropped: Column) -> Column:
    """Protected tokens always stay; else none that is dropped by name, unused, a control token or of a foreign script."""
    return protected | ~(dropped | text.is_unused(token) | text.is_control(token) | text.has_foreign_script(token))


def ranges(stored: DataFrame) -> int:
    """How many ranges a stored table is dealt to, so that none, which one task sorts or counts, grows with the table."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // RANGE_ROWS))


def numbered(rows: DataFrame, name: str, *order: Column | str, start: int = 0) -> DataFrame:
    """Adds an int column: the row's place in the order, which must leave no ties.

    Rows are written, dealt to ranges of the order and written again in order, each with its place within its range;
    these places add to the sizes of the ranges before, so that no task sees more than a range.
    """
    stored = scratch.cut(rows, "rows")
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # its high bits are the partition's
    dealt = scratch.cut(stored.repartitionByRange(ranges(stored), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_within", within), "ranges")
    scratch.forget(stored)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_within") + start).cast("int")).drop("_range", "_before", "_within")  # a row a range


def with_utility(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("utility", F.round(numeric.utility(F.col("n"), text.piece_bytes(F.col("token"))), 6))


def ranked(vocab: DataFrame) -> DataFrame:
    """token, id, n -> adds utility and place: by utility, count, then the lesser id."""
    return numbered(with_utility(vocab), "place", F.desc("utility"), F.desc("n"), "id", start=1)


def violations(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Merges (rank, left, right) of which a part or the result isn't in the vocabulary."""
    out = merges.withColumn("output", F.concat("left", "right"))
    for part in ("left", "right", "output"):
        out = out.join(vocab.select(F.col("token").alias(part), F.lit(True).alias(f"has_{part}")), part, "left").withColumn(f"has_{part}", F.coalesce(f"has_{part}", F.lit(False)))
    return out.where("NOT (has_left AND has_right AND has_output)").select("rank", "left", "right", "has_left", "has_right", "has_output")


def kept_merges(merges: DataFrame, selected: DataFrame) -> DataFrame:
    out = merges.withColumn("output", F.concat("left", "right"))
    for part in ("left", "right", "output"):
        out = out.join(selected.select(F.col("token").alias(part)), part, "left_semi")
    return out.select("rank", "left", "right", "output")


def reachable(atoms: DataFrame, merges: DataFrame) -> DataFrame:
    """token: what atoms and merges build, whatever the rank.

    Both parts of a merge are shorter than what it makes, so that what can be built is what remains once merges of parts
    that nothing makes are gone; rounds until none goes, each written to the shared folder. A merge with an empty part
    makes nothing new.
    """
    known = scratch.cut(atoms.select("token").distinct(), "atoms")
    made = scratch.cut(merges.where("left <> '' AND right <> ''").select("left", "right", F.concat("left", "right").alias("token")), "merges")
    n = made.count()
    while True:
        built = known.union(made.select("token")).distinct()
        kept = made.join(built.select(F.col("token").alias("left")), "left", "left_semi").join(built.select(F.col("token").alias("right")), "right", "left_semi")
        kept = scratch.cut(kept.select("left", "right", "token"), "merges")
        scratch.forget(made)
        made, was, n = kept, n, kept.count()
        if n == was:
            return known.union(made.select("token")).distinct()


def remapped(selected: DataFrame) -> DataFrame:
    """token, old_id, class -> new_id: by class, then old id."""
    return numbered(selected, "new_id", "class", "old_id")


def closures(merges: list[tuple[int, str, str]], allowed: set[str], atoms: set[str]) -> dict[str, frozenset[str]]:
    """For each token that allowed tokens can build, the least set of tokens that builds it; ties go to the lesser rank.

    Parts are shorter than what they make, so one sweep in order of length settles all.
    """
    parents: dict[str, list[tuple[int, str, str]]] = defaultdict(list)
    for rank, left, right in merges:
        parents[left + right].append((rank, left, right))
    best = {a: frozenset((a,)) for a in atoms if a in allowed}
    for token in sorted(parents, key=lambda t: (len(t), t)):
        if token in best or token not in allowed:
            continue
        options = [(len(u := best[a] | best[b] | {token}), rank, u) for rank, a, b in parents[token] if a in best and b in best]
        if options:
            best[token] = min(options, key=lambda o: o[:2])[2]
    return best


def select(order: list[str], closure: dict[str, frozenset[str]], required: set[str], budget: int) -> set[str]:
    """Required tokens with what builds them, then tokens in order wherever their closure still fits; repeated passes fill
    holes, and a budget that stays unmet is an error. `order` is of tokens that occur."""
    chosen: set[str] = set()
    for token in sorted(required):
        if token not in closure:
            raise ValueError(f"{token!r} can't be built")
        chosen |= closure[token]
    if len(chosen) > budget:
        raise ValueError(f"{len(chosen)} required tokens; the budget is {budget}")
    while len(chosen) < budget:
        before = len(chosen)
        for token in order:
            if token in closure and token not in chosen and len(chosen | closure[token]) <= budget:
                chosen |= closure[token]
        if len(chosen) == before:
            raise ValueError(f"only {len(chosen)} of {budget} tokens can be chosen")
    return chosen


def closures_of(tokens: list[str], vocab: DataFrame, merges: DataFrame) -> dict[str, frozenset[str]]:
    """closures() of a few tokens: what builds a token is made of its substrings, so merges and vocabulary are read once,
    for those alone."""
    parts = {t[i:j] for t in tokens for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    parts = F.broadcast(vocab.sparkSession.createDataFrame([(p,) for p in sorted(parts)], "token string"))  # of a few tokens
    allowed = {r["token"] for r in vocab.select("token").join(parts, "token", "left_semi").collect()}
    made = merges.select("rank", "left", "right", F.concat("left", "right").alias("token")).join(parts, "token", "left_semi").collect()
    return closures([(r["rank"], r["left"], r["right"]) for r in made], allowed, {t for t in allowed if len(t) == 1})


def select_spread(vocab: DataFrame, merges: DataFrame, budget: int, chunk: int = 1000) -> tuple[set[str], dict[str, frozenset[str]]]:
    """select() of single characters and then by utility, and the closures of what is chosen, from tables of any size.

    Tokens come to the driver in their order, a chunk at a time, and until the budget is met; passes repeat as there.
    """
    atoms = [r["token"] for r in vocab.where(F.char_length("token") == 1).select("token").distinct().limit(budget + 1).collect()]
    if len(atoms) > budget:
        raise ValueError(f"more than {budget} required tokens; the budget is {budget}")
    found = {t: frozenset((t,)) for t in atoms}
    chosen = set(atoms)
    order = with_utility(vocab).select("token", "utility", "n", "id")
    while len(chosen) < budget:
        before, last = len(chosen), None
        while len(chosen) < budget:
            rest = order if last is None else order.where((F.col("utility") < last["utility"]) | ((F.col("utility") == last["utility"]) & ((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("id") > last["id"])))))
            rows = rest.orderBy(F.desc("utility"), F.desc("n"), "id").limit(chunk).collect()
            if not rows:
                break
            closure = closures_of([r["token"] for r in rows], vocab, merges)
            for token in (r["token"] for r in rows):
                if token in closure and token not in chosen and len(chosen | closure[token]) <= budget:
                    chosen |= closure[token]
                    found |= {t: closure[t] for t in closure[token]}
            last, chunk = rows[-1], min(2 * chunk, 16_000)
        if len(chosen) == before:
            raise ValueError(f"only {len(chosen)} of {budget} tokens can be chosen")
    return chosen, found
