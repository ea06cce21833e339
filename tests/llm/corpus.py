"""A small corpus with the awkward cases: nulls, empty and long texts, copies, repeats, other scripts, extra columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit string, n long, h string, keys string, copies string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    heads = {"en": "the of and to in that is was for with as by on".split(), "de": "der die und das nicht ist von mit auf für ein".split(), "fr": "le la de et les des une pour que qui dans est".split()}[lang]
    tails = {"en": ["th", "er", "ing", "sh", "wh", "ou", "ly"], "de": ["sch", "ung", "ei", "ch", "tz", "ß", "keit"], "fr": ["eau", "oi", "é", "ment", "que", "ai", "ç"]}[lang]
    out = []
    for i in range(n):
        w = rng.choice(heads) if rng.random() < 0.4 else "".join(rng.choice(tails) for _ in range(rng.randint(2, 4)))
        out.append(w + ("." if i % 9 == 8 else "") + ("\n" if i % 27 == 26 else " "))
    return "".join(out).strip(" ")


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "en", "de", "fr")[i % 4]
        out.append([i, prose(rng, rng.choice((30, 80, 200, 400)), lang), lang, f"s{i % 5}" if i % 7 else None])
    shared = prose(rng, 120)
    out[20][1] = out[4][1]
    out[21][1] = out[4][1] + " and one more line"
    words = out[5][1].split(" ")
    for k, i in enumerate((22, 23, 24)):
        w = list(words)
        w[len(w) // 2 + k] = "changed"
        out[i][1] = " ".join(w)
    for i in (30, 31, 32):
        out[i][1] = prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 60)
    out[33][1] = shared + "\n" + shared
    out[34][1] = "*** $$$ ### " * 60
    out[35][1] = None
    out[36][1] = ""
    out[37][1] = " \n\t "
    out[38][1] = "12 34 !! ."
    out[39][1] = "same " * 3000
    out[40][1] = prose(rng, 9000)
    out[41][1] = "WORDS!! SHOUTED!! LOUDLY!! HERE!! " * 30
    out[42][1] = "two words"
    out[43][1] = "two words"
    out[44][2] = None
    full = [(*r, len(r[1]) if r[1] is not None else None, "u", 7, "h", None, "c") for r in out]
    return full + [full[10], full[34]]  # repeated rows


def docs(spark, n: int = 60):
    return spark.createDataFrame(rows(n=n), SCHEMA).repartition(5)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
