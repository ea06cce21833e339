"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each row gets a uniform 63-bit hash. Sizes are summed by source and leading hash bits; the running sum shows in which
bucket a source's budget runs out, and only that bucket is summed again by its next bits. After LEVELS rounds the
threshold is 36 bits fine, and the mix is a filter on the hash: no sort, no state in the driver but the plan.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in order; rows that repeat
in full share a hash and stand or fall together; an empty table gives an empty mix; a source of size 0 takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.llm import scratch

WORDS = r"[^\x20\x09-\x0D]+"
LEVELS, BITS = 3, 12
P = "__cf_mix_"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def unit_hash(*cols: Column, seed: int = 17) -> Column:
    """63 uniform bits from the row's own values, so reruns and retries agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def targets(sizes: DataFrame, weight: Column | None = None, budget: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, size) -> (source, size, target): weighted shares of budget x all sizes, none above cap x its source.

    The reshared excess has a closed form: sources are capped in the order of cap x size / weight, and the first source
    that its share doesn't fill fixes the level for all after it. weight defaults to 1, 2, 3 in turn by source.
    """
    everyone, by_source = W.partitionBy(), W.orderBy(F.asc_nulls_last("source"))
    ranked = (
        sizes.withColumn("n", F.row_number().over(by_source))
        .withColumn("weight", ((F.col("n") - 1) % 3 + 1 if weight is None else weight).cast("double"))
        .withColumn("most", F.col("size") * F.lit(float(cap)))
        .withColumn("ratio", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")))
    )
    order = W.orderBy(F.asc_nulls_last("ratio"), "n")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    on = order.rowsBetween(0, W.unboundedFollowing)
    level = (
        ranked.withColumn("total", F.sum("size").over(everyone) * F.lit(float(budget)))
        .withColumn("left", F.sum("weight").over(on))
        .withColumn("level", F.when(F.col("left") > 0, (F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.col("left")))
        .withColumn("fill", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level"))).over(everyone))
    )
    share = F.coalesce(F.col("fill.level") * F.col("weight"), F.col("most"))
    return level.select("source", "size", F.least(F.col("most"), share).alias("target"))


def thresholds(facts: DataFrame, goals: DataFrame) -> DataFrame:
    """facts (source, size, h), goals (source, size, target) -> source, size, target, full, below.

    A row of the source is taken `full` times, and once more where its hash is less than `below`.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("full", whole).withColumn("rest", F.col("target") - F.col("full") * F.col("size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = 63 - BITS * level
        inside = facts.alias("f").join(state.alias("g"), F.col("f.source").eqNullSafe(F.col("g.source")) & (F.shiftrightunsigned(F.col("h"), shift + BITS) == F.col("g.prefix")))
        sums = inside.groupBy(F.col("g.source").alias("source"), F.shiftrightunsigned(F.col("h"), shift).alias("slot")).agg(F.sum("f.size").alias("here"), F.first("g.rest").alias("rest"), F.first("g.base").alias("base"))
        run = W.partitionBy("source").orderBy("slot")
        edge = (
            sums.withColumn("upto", F.col("base") + F.sum("here").over(run))
            .groupBy("source")
            .agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("slot", (F.col("upto") - F.col("here")).alias("base"), F.col("upto")))).alias("edge"), F.max("slot").alias("last"), F.max("upto").alias("all"))
        )
        # No bucket overruns the budget: every row of this prefix is below it, and later levels find nothing to refine.
        found = edge.select("source", F.coalesce("edge.slot", F.col("last") + 1).alias("slot"), F.coalesce("edge.base", "all").alias("at"), F.col("edge.upto").alias("over"))
        state = (
            state.alias("s")
            .join(found.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
            .select("s.source", "s.size", "s.target", "s.full", "s.rest", F.coalesce("e.slot", F.col("s.prefix") * (1 << BITS)).alias("prefix"), F.coalesce("e.at", "s.base").alias("base"), F.col("e.over").alias("over"))
        )
        if level < LEVELS:
            state = scratch.cut(state.drop("over"), "mix-level")
    # The last boundary slot goes in if that ends nearer to the budget.
    near = (F.col("over") - F.col("rest")) < (F.col("rest") - F.col("base"))
    below = (F.col("prefix") + F.when(near & F.col("over").isNotNull(), 1).otherwise(0)) * F.lit(1 << (63 - BITS * LEVELS))
    # A source whose whole copies fill its target takes no further one, not even of rows without a word.
    some = F.col("rest") > F.col("size") * F.lit(1e-9)
    return state.select("source", "size", "target", "full", F.when(some, below).otherwise(F.lit(0)).alias("below"))


def _facts(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text, ident, source = docs[text_col], docs[id_col], docs[source_col]
    return docs.select(ident.alias("doc_id"), source.alias("source"), n_words(text).alias("size"), unit_hash(ident, text, seed=seed).alias("h"))


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **shares: object) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    facts = scratch.cut(_facts(docs, id_col, text_col, source_col, seed), "mix-facts")
    goals = scratch.cut(targets(facts.groupBy("source").agg(F.sum("size").alias("size")), **shares).coalesce(1), "mix-goals")
    plan = scratch.cut(thresholds(facts, goals).coalesce(1), "mix-plan")
    f, g = facts.alias("f"), plan.alias("g")
    times = F.col("g.full") + F.when(F.col("f.h") < F.col("g.below"), 1).otherwise(0)
    return f.join(g, F.col("f.source").eqNullSafe(F.col("g.source"))).select("f.doc_id", "f.size", F.col("g.size").alias("source_size"), "g.target", (F.col("f.size") * times).cast("long").alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, copies_col: str = "copies", **shares: object) -> DataFrame:
    """The rows that the mix takes, with their own columns and how often each is to be repeated (copies_col)."""
    facts = scratch.cut(_facts(docs, id_col, text_col, source_col, seed).drop("doc_id"), "mix-facts")
    goals = scratch.cut(targets(facts.groupBy("source").agg(F.sum("size").alias("size")), **shares).coalesce(1), "mix-goals")
    plan = scratch.cut(thresholds(facts, goals).coalesce(1), "mix-plan").select(*[F.col(c).alias(P + c) for c in ("source", "full", "below")])
    hashed = docs.withColumn(P + "h", unit_hash(docs[id_col], docs[text_col], seed=seed))
    joined = hashed.join(plan, hashed[source_col].eqNullSafe(plan[P + "source"]))
    times = (F.col(P + "full") + F.when(F.col(P + "h") < F.col(P + "below"), 1).otherwise(0)).cast("int")
    keep = [joined[c] for c in docs.columns if c != copies_col]
    return joined.select(*keep, times.alias(copies_col)).where(F.col(copies_col) > 0)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
