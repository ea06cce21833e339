"""Near-duplicate detection by MinHash with tensored banding.

A document computes COLLECTIONS small collections of WIDTH minhashes; every pair of collections keys one table, so 60
minhashes serve the 190 tables of six rows that would need 1,140. Only collections that two documents share can key a
table that they share, so the others drop out before pairs are formed. Two documents of similarity s miss each other if
they share fewer than two collections: at 0.75, 3 pairs in 10,000; at 0.85, less than 1 in 10 million.

Equal sets of shingles are one node. Nodes are ordered by how much they share with others; in each table key the first
leads. A node is confirmed against the leader it shares most keys with, confirmed links are contracted to components,
and of the other leaders only those matter whose group still holds more than one component. Members of such a group
that remain in different components are compared if sizes, or the rarest shingles that they share outside the leader,
allow a link at all (strays). So no link of a key is lost that would join two components, and a group of copies costs
rows in proportion to its size.

Shingles, sets and collections compare by 64-bit hashes (sets by 128 bits). Defined results: null and empty texts have
no shingles and link with nothing; fewer words than a shingle make one shingle; rows with a null id link with nothing;
rows that repeat an id are judged each by its own text; ids may be of any type that has an order; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs
from corpusforge.llm import scratch

COLLECTIONS, WIDTH, SHINGLE, PERCENT = 20, 3, 5, 75
_ODD = bs._table(71, COLLECTIONS * WIDTH) | bs.U64(1)
_ADD = bs._table(72, COLLECTIONS * WIDTH)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted and one after the other, and where each document's begin."""
    start, end, before = bs.word_bounds(bs.LOWER[data], offsets)
    roll = bs.Rolling(bs.word_hashes(bs.LOWER[data], start, end))
    n = np.diff(before)
    spans = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = bs.spread(before[:-1], spans)
    stop = at + np.minimum(size, np.repeat(n, spans))
    hashes = roll.of(at, stop)
    edge = np.concatenate(([0], np.cumsum(spans)))
    sets = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate(([0], np.cumsum([len(x) for x in sets])))


def collections(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Documents x COLLECTIONS keys; all documents must have a shingle."""
    least = np.stack([np.minimum.reduceat(hashes * m + a, edge[:-1]) for m, a in zip(_ODD, _ADD, strict=True)], 1)
    out = np.zeros((len(least), COLLECTIONS), np.uint64)
    for j in range(WIDTH):
        out = bs.mix(out * bs.U64(0x9E3779B97F4A7C15) + least[:, j::WIDTH], j + 1)
    return bs.mix(out + np.arange(COLLECTIONS, dtype=np.uint64)[None, :], 9)


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (shingles), f1, f2 (the set's fingerprint), keys (null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(1)):
                hashes, edge = shingle_sets(data, offsets)
                n = np.diff(edge)
                full = n > 0
                prints, keys = np.zeros((2, len(n)), np.uint64), np.zeros((0, COLLECTIONS), np.uint64)
                if full.any():
                    some = np.append(edge[:-1][full], edge[-1])
                    prints[:, full] = [np.add.reduceat(bs.mix(hashes, salt), some[:-1]) for salt in (3, 4)]
                    keys = collections(hashes, some)
                ends = np.concatenate(([0], np.cumsum(np.where(full, COLLECTIONS, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), *(pa.array(p.view(np.int64)) for p in prints), lists], ["doc_id", "n", "f1", "f2", "keys"])

    return _text(docs, id_col, text_col).mapInArrow(sign, f"doc_id {_kind(docs, id_col)}, n long, f1 long, f2 long, keys array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the documents in ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(1)):
                hashes, edge = shingle_sets(data, offsets)
                sets = pa.array([hashes[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], sets], ["id", "shingles"])

    wanted = ids.select(F.col("id").alias("doc_id")).hint("merge")
    return _text(docs, id_col, text_col).join(wanted, "doc_id", "left_semi").mapInArrow(read, f"id {_kind(docs, id_col)}, shingles binary")


def linked(percent: int) -> F.Column:
    return 100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int, outside: bool = False) -> DataFrame:
    """a, b, na, nb, same: the sizes of the pairs' full sets and of their intersection.

    With outside also `out`: the shingles of a that its leader b lacks, the least first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, parts, n = np.zeros((3, batch.num_rows), np.int64), [np.zeros(0, np.uint64)], [0]
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                sums[:, i] = len(x), len(y), (both[1:] == both[:-1]).sum()
                if outside:
                    out = np.setdiff1d(x, y, assume_unique=True)
                    parts.append(out)
                    n.append(len(out))
            columns, names = [batch.column(0), batch.column(1), *map(pa.array, sums)], ["a", "b", "na", "nb", "same"]
            if outside:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), pa.array(np.concatenate(parts).view(np.int64))))
                names.append("out")
            yield pa.RecordBatch.from_arrays(columns, names)

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    # Both sides grow with the corpus: neither is broadcast, even where a small one would fit.
    full = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")
    kind = pairs.schema["a"].dataType.simpleString()
    return full.mapInArrow(count, f"a {kind}, b {kind}, na long, nb long, same long" + ", out array<long>" * outside)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes that have an edge (a, b): the least node reachable.

    Every node points to its least neighbour or itself, pointers are followed to their roots, and edges are carried
    over to the roots, until no edge is left between two of them.
    """
    links, labels = scratch.cut(edges.select("a", "b").where("a <> b").distinct(), "neardup-edges"), None
    while labels is None or not links.isEmpty():
        both = links.union(links.select("b", "a"))
        up = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("up")), "neardup-up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            new = scratch.cut(up.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "neardup-up")
            scratch.forget(up)
            up = new.select("node", "up")
            up._corpusforge_path = new._corpusforge_path
            if new.where("moved").isEmpty():
                break
        ends = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = scratch.cut(links.join(ends[0], "a").join(ends[1], "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "neardup-edges")
        if labels is None:
            new = scratch.cut(up.select("node", F.col("up").alias("label")), "neardup-labels")
        else:
            over = up.select(F.col("node").alias("label"), F.col("up").alias("top"))
            new = scratch.cut(labels.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "neardup-labels")
        scratch.forget(links, up, *([labels] if labels is not None else []))
        links, labels = left, new
    scratch.forget(links)
    return labels


def united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: components of the components that these join."""
    found = scratch.cut(_owned(links, labels).select(F.col("own").alias("a"), F.col("lead_own").alias("b")).distinct(), "neardup-found")
    if found.where("a <> b").isEmpty():
        return labels
    roots = components(found)
    old = labels.unionByName(roots.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
    over = roots.select(F.col("node").alias("label"), F.col("label").alias("top"))
    new = scratch.cut(old.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "neardup-labels")
    scratch.forget(found, roots, labels)
    return new


def _owned(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the components of both: own, lead_own."""
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("own_label"))
    lead = labels.select(F.col("node").alias("b"), F.col("label").alias("lead_label"))
    joined = pairs.join(own, "a", "left").join(lead, "b", "left")
    return joined.select(*pairs.columns, F.coalesce("own_label", "a").alias("own"), F.coalesce("lead_label", "b").alias("lead_own"))


def mixed_groups(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """The stars (a, b, score) of leaders b whose group holds a member apart from the leader's component; all: its size."""
    owned = scratch.cut(_owned(stars, labels), "neardup-owned")
    sizes = owned.groupBy("b").agg(F.count_if(F.col("own") != F.col("lead_own")).alias("k"), F.count(F.lit(1)).alias("all"))
    heads = scratch.cut(sizes.where("k > 0").select("b", "all"), "neardup-heads")
    out = scratch.cut(owned.join(heads, "b").select("a", "b", "score", "all"), "neardup-mixed")
    scratch.forget(owned, heads)
    return out


def strays(members: DataFrame, percent: int) -> DataFrame:
    """members (a, b, na, same, out, own, lead_own, low) of mixed groups -> pairs (a, b) of them that may still be linked.

    A link of x and y needs percent / (100 + percent) of |x| + |y| in common; within their leader that is `same` of
    either at most, so what lacks, `need`, lies outside it. Where nothing lacks, bands of sizes that suffice meet. All
    others must share `need` shingles outside the leader, so they meet by the rarest of those that a second component
    of the group has too, all but need - 1; most members haven't got as many and drop out. From their first common one
    on, both must still have as many as the two of them need. low: the group's least size.
    """
    p = float(percent)
    band = lambda n: F.floor(F.log(n) / math.log(1.03)).cast("int")
    least, apart = F.ceil(F.lit(p / 100) * F.col("na") - 1e-9), F.col("own") != F.col("lead_own")
    most = F.floor(F.lit((100 + p) / p) * F.col("same") - F.col("na") + 1e-9)  # the largest partner that sharing `same` can link
    need = F.greatest(F.lit(1), F.ceil(F.lit(p / (100 + p)) * (F.col("na") + F.greatest(least, "low")) - 1e-9) - F.col("same"))
    near = scratch.cut(members.select("a", "b", "na", "same", "own", apart.alias("apart"), least.alias("least"), most.alias("most"), need.alias("need"), "out"), "neardup-near")
    side = lambda x, *names: [F.col(c).alias(x + c) for c in names]
    able = near.where("most >= least")
    y = able.where("apart").select("b", *side("y", "a", "na", "own", "least", "most"), F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("band"))
    x = able.select("b", *side("x", "a", "na", "own", "least", "most"), band(F.col("na")).alias("band"))
    by_size = y.join(x, (y["b"] == x["b"]) & (y["band"] == x["band"]) & (F.col("yown") != F.col("xown")) & F.col("xna").between(F.col("yleast"), F.col("ymost")) & F.col("yna").between(F.col("xleast"), F.col("xmost")))
    outside = scratch.cut(near.where(F.size("out") >= F.col("need")).select("a", "b", "na", "same", "own", "apart", "need", F.explode("out").alias("s")), "neardup-outside")
    tally = outside.groupBy("b", "s").agg(F.count(F.lit(1)).alias("df"), F.max("apart").alias("some"), F.min("own").alias("first"), F.max("own").alias("last"))
    shared = scratch.cut(tally.where("some AND first <> last").select("b", "s", "df"), "neardup-shared")
    member = W.partitionBy("a", "b")
    placed = outside.join(shared, ["b", "s"]).withColumn("m", F.count(F.lit(1)).over(member)).withColumn("i", F.row_number().over(member.orderBy("df", "s")))
    rest = (F.col("m") - F.col("i") + 1).alias("rest")  # shared shingles from this one on
    meet = scratch.cut(placed.where("i <= m - need + 1").select("a", "b", "s", "na", "same", "own", "apart", rest), "neardup-meet")
    left = meet.where("apart").select("b", "s", *side("y", "a", "own", "na", "same", "rest"))
    right = meet.select("b", "s", *side("x", "a", "own", "na", "same", "rest"))
    lacks = F.ceil(F.lit(p / (100 + p)) * (F.col("yna") + F.col("xna")) - 1e-9) - F.least("ysame", "xsame")
    fits = (F.col("yown") != F.col("xown")) & (F.least("yrest", "xrest") >= lacks) & (100 * F.least("yna", "xna") >= percent * F.greatest("yna", "xna"))
    by_shingle = left.join(right, (left["b"] == right["b"]) & (left["s"] == right["s"]) & fits)
    both = by_size.select("xa", "ya").union(by_shingle.select("xa", "ya"))
    out = scratch.cut(both.select(F.least("xa", "ya").alias("a"), F.greatest("xa", "ya").alias("b")).distinct(), "neardup-rest")
    scratch.forget(near, outside, shared, meet)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable over links), kept."""
    signed = scratch.cut(signatures(docs, id_col, text_col), "neardup-signatures")
    same = ["f1", "f2", "n"]
    # Written before it is joined, so that the join's sides can be split where a set has very many copies.
    first = scratch.cut(signed.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "neardup-first")
    node = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("rep"))
    members = scratch.cut(signed.join(first, same, "left").select("doc_id", "n", node.alias("rep"), F.when(F.col("doc_id") == node, F.col("keys")).alias("keys")), "neardup-members")
    scratch.forget(signed, first)

    single = members.where("keys is not null").select("rep", F.explode("keys").alias("key"))
    shared = single.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    ranked = single.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("ks"), F.sum("size").alias("score"))
    nodes = scratch.cut(ranked.where(F.size("ks") > 1), "neardup-nodes")
    table = F.flatten(F.transform("ks", lambda x, i: F.transform(F.slice("ks", i + 2, COLLECTIONS), lambda y: F.xxhash64(x, y))))
    keyed = nodes.select("rep", "score", F.explode(table).alias("pk"))
    lead = keyed.groupBy("pk").agg(F.min(F.struct((-F.col("score")).alias("s"), "rep")).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1")
    inside = keyed.join(lead.select("pk", F.col("top.rep").alias("leader")), "pk").where(F.col("rep") != F.col("leader"))
    stars = scratch.cut(inside.groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("keys"), F.max("score").alias("score")), "neardup-stars")
    ids = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    sets = scratch.cut(full_sets(docs, ids, id_col, text_col), "neardup-sets")
    scratch.free_shuffles(docs.sparkSession)

    # Each node's likeliest leader settles most of a group; what the other leaders add is asked only of groups that hold two components.
    best = stars.groupBy("a").agg(F.min(F.struct((-F.col("keys")).alias("k"), "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    labels = components(overlaps(best, sets, percent).where(linked(percent)))
    pairs = mixed_groups(stars.select("a", "b", "score"), labels)
    scratch.forget(stars)
    seen = scratch.cut(overlaps(pairs, sets, percent, outside=True), "neardup-overlaps")
    labels = united(labels, seen.where(linked(percent)).select("a", "b"))
    owned = scratch.cut(_owned(seen.join(pairs.where("all > 1").select("a", "b"), ["a", "b"]), labels), "neardup-owned")
    sizes = owned.groupBy("b").agg(F.max(F.col("own") != F.col("lead_own")).alias("mixed"), F.count(F.lit(1)).alias("all"), F.min("na").alias("low"))
    heads = scratch.cut(sizes.where("mixed AND all > 1").select("b", "low"), "neardup-heads")
    rest = strays(owned.join(heads, "b"), percent)
    scratch.forget(pairs, seen, owned, heads)
    if not rest.isEmpty():
        labels = united(labels, overlaps(rest, sets, percent).where(linked(percent)).select("a", "b"))
    out = members.select("doc_id", "n", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
