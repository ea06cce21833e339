"""Pruning a byte-pair tokenizer to a smaller vocabulary: protection, renumbering, merge filter, checks, model file.

Vocabularies and merges are tables; only the finished model, whose size is the budget, is put together on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import vocabulary

LEADING, CUSTOM, NATIVE = 0, 1, 2


def token_list(spark: SparkSession, tokens: Sequence[str], place: str = "place") -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokens)), f"{place} int, token string").select("token", place)


def missing(required: DataFrame, vocab: DataFrame) -> DataFrame:
    """token: the required ones that the vocabulary lacks."""
    return required.select("token").distinct().join(vocab.select("token"), "token", "left_anti")


def protected(vocab: DataFrame, *sources: DataFrame) -> DataFrame:
    """token: atoms of the vocabulary and all that the sources name, each once; one that the vocabulary lacks is an error."""
    atoms = vocab.where(text.is_atom(F.col("token")) | text.is_run_of(F.col("token"), text.SPACE_MARK)).select("token")
    for s in sources:
        atoms = atoms.union(s.select("token"))
    known = atoms.distinct().join(vocab.select("token", F.lit(True).alias("known")), "token", "left")
    complaint = F.raise_error(F.concat(F.lit("not in the vocabulary: "), "token"))
    return known.select(F.when(F.col("known"), F.col("token")).otherwise(complaint.cast("string")).alias("token"))


def renumbered(chosen: DataFrame, vocab: DataFrame, leading: DataFrame, custom: DataFrame) -> DataFrame:
    """token, new_id, old_id: leading specials and custom ones in their own order, then the rest by old id.

    Custom specials are new, so their old id is null; one that the vocabulary has already is an error.
    """
    clash = F.raise_error(F.concat(F.lit("already in the vocabulary: "), "token")).cast("string")
    first = leading.select("token", F.lit(LEADING).alias("class"), F.col("place").cast("long").alias("at"))
    own = custom.join(vocab.select("token", F.lit(True).alias("known")), "token", "left").select(F.when(F.col("known"), clash).otherwise(F.col("token")).alias("token"), F.lit(CUSTOM).alias("class"), F.col("place").cast("long").alias("at"))
    rest = chosen.select("token").distinct().join(leading.select("token"), "token", "left_anti").join(vocab.select("token", F.col("id").cast("long").alias("at")), "token").select("token", F.lit(NATIVE).alias("class"), "at")
    every = first.unionByName(own).unionByName(rest)
    placed = vocabulary.numbered(every, "new_id", "class", "at")
    return placed.join(vocab.select("token", F.col("id").alias("old_id")), "token", "left").select("token", "new_id", "old_id")


def inverse(renamed: DataFrame, vocab: DataFrame) -> DataFrame:
    """old_id, new_id (-1: dropped) for every id of the old vocabulary."""
    new = renamed.where("old_id IS NOT NULL").select("old_id", "new_id")
    return vocab.select(F.col("id").alias("old_id")).join(new, "old_id", "left").select("old_id", F.coalesce("new_id", F.lit(-1)).alias("new_id"))


def mapping_errors(renamed: DataFrame, vocab: DataFrame) -> DataFrame:
    """new_id, token, old_token where the old id names another token."""
    old = vocab.select(F.col("id").alias("old_id"), F.col("token").alias("old_token"))
    return renamed.join(old, "old_id").where("token <> old_token").select("new_id", "token", "old_token")


def checks(renamed: DataFrame, merges: DataFrame, vocab: DataFrame, atoms: DataFrame, leading: DataFrame, expected: int) -> DataFrame:
    """name, ok: one row for each condition that a pruned tokenizer must meet."""
    count = F.count(F.lit(1))
    size = renamed.agg((count == expected).alias("size"), ((F.count_distinct("new_id") == count) & (F.min("new_id") == 0) & (F.max("new_id") == count - 1)).alias("dense_ids"), (F.count_distinct("token") == count).alias("tokens_once"))
    empty = lambda rows, name: rows.agg((count == 0).alias(name))
    native = renamed.where("old_id IS NOT NULL").select("token")
    parts = [
        size,
        empty(missing(leading, renamed), "specials_kept"),
        empty(missing(atoms, renamed), "atoms_kept"),
        empty(vocabulary.violations(merges.select("rank", "left", "right"), renamed), "merges_closed"),
        empty(mapping_errors(renamed, vocab), "mapping_exact"),
        empty(leading.join(renamed, "token").where("new_id <> place"), "leading_ids"),
        empty(native.join(vocabulary.reachable(atoms.join(native, "token", "left_semi").union(leading.select("token")), merges), "token", "left_anti"), "reachable"),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # one row each
    names = row.columns
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("ok")) for n in names])).alias("c")).select("c.name", "c.ok")


def special(vocab: Sequence[str] | dict, requested: str | None, fallbacks: Sequence[str] = ("<bos>", "<|bos|>")) -> str:
    """The boundary token: the requested one, or the first fallback that the vocabulary has; else an error."""
    wanted = [requested] if requested else list(fallbacks)
    for token in wanted:
        if token in vocab:
            return token
    raise ValueError(f"the vocabulary has none of {wanted}")


def first_known(candidates: Column, known: Column) -> Column:
    """special() over columns: the first of an array of candidates that the array `known` holds, null if none does."""
    return F.try_element_at(F.filter(candidates, lambda x: F.array_contains(known, x)), F.lit(1))


def model_file(source: dict, renamed: DataFrame, merges: DataFrame, boundary: str) -> dict:
    """The source's model with the new vocabulary and merges, records of the specials, and a template that puts one
    boundary token before a text. renamed and merges are no larger than the budget."""
    rows = renamed.orderBy("new_id").collect()
    ids = {r["token"]: r["new_id"] for r in rows}
    known = {x["content"]: x for x in source.get("added_tokens") or []}
    marked = [r["token"] for r in rows if r["token"] in known or r["old_id"] is None]
    plain = dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized"), False)
    at = {"SpecialToken": {"id": boundary, "type_id": 0}}
    side = lambda name, kind: {"Sequence": {"id": name, "type_id": kind}}
    template = {
        "type": "TemplateProcessing",
        "single": [at, side("A", 0)],
        "pair": [at, side("A", 0), {"SpecialToken": {"id": boundary, "type_id": 1}}, side("B", 1)],
        "special_tokens": {boundary: {"id": boundary, "ids": [ids[boundary]], "tokens": [boundary]}},
    }
    pairs = [[r["left"], r["right"]] for r in merges.orderBy("rank").collect()]
    added = [known.get(t, {}) | plain | {"id": ids[t], "content": t, "special": True} for t in marked]
    return source | {"model": source["model"] | {"vocab": ids, "merges": pairs}, "added_tokens": added, "post_processor": template}


def prune(spark: SparkSession, source: dict, counts: DataFrame, budget: int, *, leading: Sequence[str], custom: Sequence[str] = (), keep: Sequence[str] = (), dropped: Sequence[str] = (), boundary: str | None = None) -> dict[str, object]:
    """A tokenizer model and counts (id, n) -> model, mapping tables and checks of a vocabulary of `budget` tokens.

    Protected are leading specials, atoms and `keep`; then tokens follow by utility as long as what builds them fits.
    """
    vocab = spark.createDataFrame(sorted(source["model"]["vocab"].items(), key=lambda x: x[1]), "token string, id int").join(counts.select("id", "n"), "id", "left").select("token", "id", F.coalesce("n", F.lit(0)).alias("n"))
    parts = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in source["model"]["merges"]]
    merges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(parts)], "rank int, left string, right string")
    first, own = token_list(spark, leading), token_list(spark, custom)
    guarded = protected(vocab, first, token_list(spark, keep))
    fit = vocabulary.eligible(F.col("token"), F.col("guarded"), F.col("token").isin(*dropped) if dropped else F.lit(False))
    marked = vocab.join(guarded.withColumn("guarded", F.lit(True)), "token", "left").withColumn("guarded", F.coalesce("guarded", F.lit(False))).where(fit)
    rows = vocabulary.ranked(marked).orderBy("place").collect()  # the vocabulary of one model file
    allowed = {r["token"] for r in rows}
    atoms = {r["token"] for r in rows if len(r["token"]) == 1 or r["token"] in leading} | {t for t in allowed if t.startswith("<0x") and len(t) == 6}
    built = vocabulary.closures([(i, a, b) for i, (a, b) in enumerate(parts)], allowed, atoms)
    chosen = vocabulary.select([r["token"] for r in rows if r["n"] > 0], built, {r["token"] for r in rows if r["guarded"]}, budget - len(custom))
    selected = spark.createDataFrame([(t,) for t in sorted(chosen)], "token string")
    renamed = renumbered(selected, vocab, first, own)
    kept = vocabulary.kept_merges(merges, selected)
    tests = checks(renamed, kept, vocab, vocab.where(text.is_atom(F.col("token"))).select("token").join(selected, "token", "left_semi"), first, budget)
    return {"model": model_file(source, renamed, kept, special(leading, boundary)), "ids": renamed, "inverse": inverse(renamed, vocab), "merges": kept, "checks": tests}


def round_trips(model: dict, texts: Sequence[str]) -> list[tuple[str, bool]]:
    """(text, whether it comes back) by the public tokenizer library; texts are a fixed list of probes."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(json.dumps(model))
    return [(t, tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) == t) for t in texts]
