"""Quality rules as weak supervision (DataFrame functions only).

Each rule votes good, bad or abstains. Documents are counted by their pattern of votes, which makes at most 3^rules
rows whatever the corpus; expectation-maximisation on those counts estimates each rule's accuracy and the share of good
documents, and the posterior probability of good replaces all-must-pass filtering.

Defined results: a null or empty text has no words, every count is 0 and the base check fails; ties at probability 0.5
are kept; an empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: The printable ASCII characters that are neither letters nor space.
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
ROUNDS = 25
P = "__cf_qr_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, even where the body uses it in nested functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def n_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(without(text, chars))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array.

    Windows are sorted by hash within the row; those equal to a neighbour repeat, and their words are counted once.
    """

    def tail(order: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(order, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(order, i + 1)["h"] == x["h"], F.lit(False))

        at = F.flatten(F.transform(F.filter(order, again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(at))

    def head(w: Column) -> Column:
        def window(i: Column) -> Column:
            a, b, c = F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)
            return F.struct(F.xxhash64(a, b, c).alias("h"), i.alias("i"))

        triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(triples), tail))

    return let(words, head)


def measures(text: Column) -> dict[str, Column]:
    """The counts the rules read; all long. Each is an expression on the text alone."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))

    lines = F.filter(F.split(t, "\n", -1), lambda x: without(x, SPACES) != "")
    return {
        "words": let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
        "word_chars": F.length(without(t, SPACES)).cast("long"),
        "n_symbols": n_of(t, SYMBOLS),
        "n_calls": n_of(t, "!"),
        "n_stops": n_of(t, ".?!"),
        "n_marks": n_of(t, MARKS),
        "n_symbol_ends": F.regexp_count(t, F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\z)")).cast("long"),
        "n_shouts": F.regexp_count(t, F.lit(r"\p{Lu}{3,}")).cast("long"),
    }


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(m: Callable[[str], Column]) -> dict[str, Column]:
    """Votes 1 (good), -1 (bad) or 0 (abstains) from the measures; thresholds are ratios, alike at every length."""
    n = F.greatest(m("n_words"), F.lit(1))
    share = lambda c: m(c) / n
    return {
        "length": vote(m("n_words") >= 50, m("n_words") < 20),
        "symbols": vote(share("n_symbols") < 0.02, share("n_symbols") > 0.1),
        "letters": vote(m("n_marks") * 100 <= 7 * m("word_chars"), m("n_marks") * 100 > 12 * m("word_chars")),
        "symbol_ends": vote(share("n_symbol_ends") < 0.05, share("n_symbol_ends") > 0.25),
        "lines": vote(m("n_dup_lines") * 10 <= m("n_lines"), (m("n_dup_lines") * 2 > m("n_lines")) & (m("n_dup_lines") >= 3)),
        "repeats": vote(share("n_repeat_words") < 0.15, share("n_repeat_words") > 0.5),
        "shouting": vote(share("n_shouts") < 0.05, share("n_shouts") > 0.3),
        "calls": vote(share("n_calls") < 0.03, share("n_calls") > 0.15),
        "word_length": vote((m("word_chars") / n).between(2.5, 12), (m("word_chars") / n < 1.5) | (m("word_chars") / n > 20)),
        "sentences": vote(share("n_stops").between(0.02, 0.3), (m("n_stops") == 0) & (m("n_words") >= 50)),
    }


RULES = ("length", "symbols", "letters", "symbol_ends", "lines", "repeats", "shouting", "calls", "word_length", "sentences")


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the measures as columns and the votes as an array in the order of RULES."""
    m = measures(docs[text_col])
    wide = docs.select(docs[id_col].alias("doc_id"), *[c.alias(k) for k, c in m.items()])
    flat = wide.select("doc_id", F.col("words.n").alias("n_words"), F.col("words.r").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"), F.col("lines.d").alias("n_dup_lines"), "word_chars", "n_symbols", "n_calls", "n_stops", "n_shouts", "n_marks", "n_symbol_ends")
    votes = rules(F.col)
    return flat.withColumn("votes", F.array(*[votes[k].cast("int") for k in RULES]))


VALUES = (1, -1, 0)
#: Start and prior of P(vote | class): a rule seldom blames a good document, and each finds only some of the bad ones,
#: since bad documents differ in what is wrong with them. WRONG bounds P(bad vote | good document).
START = {"good": (0.92, 0.005, 0.075), "bad": (0.77, 0.17, 0.06)}
WRONG = 0.01
Model = tuple[float, list[list[float]], list[list[float]]]


def _posterior(place: Column, prior: Column, good: Column, bad: Column) -> Column:
    """Probability of good; place has for each rule where its vote stands in VALUES."""
    rule = F.sequence(F.lit(0), F.lit(len(RULES) - 1))
    at = lambda table, j: F.get(F.get(table, j), F.get(place, j))
    odds = F.aggregate(rule, F.log(prior / (1 - prior)), lambda s, j: s + F.log(at(good, j) / at(bad, j)))
    return 1 / (1 + F.exp(-odds))


def _table(weighted: Column, part: str, pseudo: Column) -> Column:
    """P(vote | class) of each rule from patterns with the class's share of their counts, START as its prior."""

    def row(j: Column) -> Column:
        return let(F.array(*[mass(j, i) for i in range(3)]), shares)

    def mass(j: Column, i: int) -> Column:
        return F.aggregate(weighted, pseudo * F.lit(START[part][i]), lambda s, x: s + F.when(F.get(x["place"], j) == i, x[part]).otherwise(0.0))

    def shares(m: Column) -> Column:
        total = F.get(m, F.lit(0)) + F.get(m, F.lit(1)) + F.get(m, F.lit(2))
        return let(F.transform(m, lambda x: x / total), bounded if part == "good" else lambda p: p)

    def bounded(p: Column) -> Column:
        wrong = F.get(p, F.lit(1))
        return F.when(wrong <= WRONG, p).otherwise(F.transform(p, lambda x, i: F.when(i == 1, F.lit(WRONG)).otherwise(x * (1 - WRONG) / (1 - wrong))))

    return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), row)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Model:
    """(share of good, P(vote | good), P(vote | bad) of each rule) by expectation-maximisation over (votes, n) rows.

    The start carries a Dirichlet prior worth 2 % of the corpus, so the classes can't change places and a rule that
    always abstains says nothing. All rounds fold over the bounded array of patterns in one expression.
    """
    place = F.transform("votes", lambda v: F.when(v == 1, 0).when(v == -1, 1).otherwise(2))
    row = patterns.agg(F.collect_list(F.struct(place.alias("place"), F.col("n").cast("double").alias("n"))).alias("seen"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))
    start = [F.array(*[F.array(*[F.lit(x) for x in START[y]]) for _ in RULES]) for y in ("good", "bad")]
    total = F.greatest(F.col("total"), F.lit(1.0))
    pseudo = F.greatest(F.lit(1.0), F.lit(0.02) * total)

    def step(state: Column, _: Column) -> Column:
        def weigh(x: Column) -> Column:
            return let(_posterior(x["place"], state["prior"], state["good"], state["bad"]), lambda p: F.struct(x["place"].alias("place"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad")))

        def maximise(w: Column) -> Column:
            prior = F.aggregate(w, F.lit(0.0), lambda s, x: s + x["good"]) / total
            return F.struct(F.least(F.lit(0.99), F.greatest(F.lit(0.5), prior)).alias("prior"), _table(w, "good", pseudo).alias("good"), _table(w, "bad", pseudo).alias("bad"))

        return let(F.transform("seen", weigh), maximise)

    first = F.struct(F.lit(0.85).alias("prior"), start[0].alias("good"), start[1].alias("bad"))
    model = F.when(F.size("seen") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)).otherwise(first)
    got = row.select(model.alias("m")).first()["m"]
    return got["prior"], got["good"], got["bad"]


def posterior(votes: Column, model: Model) -> Column:
    prior, good, bad = model
    odds = F.lit(math.log(prior / (1 - prior)))
    for j in range(len(RULES)):
        v = F.get(votes, F.lit(j))
        for i, value in enumerate(VALUES):
            odds = odds + F.when(v == value, F.lit(math.log(good[j][i] / bad[j][i]))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the measures, base_failed, quality (posterior probability of good) and kept."""
    facts = scratch.cut(measured(docs, id_col, text_col), "rules-facts")
    patterns = scratch.cut(facts.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "rules-patterns")
    model = estimate(patterns)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        facts.withColumn("base_failed", failed)
        .withColumn("quality", posterior(F.col("votes"), model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
