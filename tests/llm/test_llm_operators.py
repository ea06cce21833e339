import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import SCHEMA, WORD, docs, none, prose, rows
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs
from corpusforge.llm import decontamination, language_id, licenses, lines, mixing, neardup, quality_classifier, quality_rules, substrings, suffixes, units


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    docs(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unique(found, key="doc_id"):
    """Rows by id; rows that repeat must have got equal results."""
    out = {}
    for r in found:
        assert out.setdefault(r[key], r) == r
    return out


# op1

def components(data, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in data:
        w = WORD.findall((r[1] or "").translate(lower))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates(spark, corpus):
    want = components(rows())
    got = unique(neardup.near_duplicates(corpus).collect())
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())
    assert got[43].component_id == 42 and got[36].component_id == 36


def test_near_duplicate_chain_and_star(spark):
    """A chain of drifting copies, whose ends aren't linked, and a star of copies that link with their centre only."""
    words = [f"w{i}" for i in range(300)]
    data = []
    for k in range(12):
        data.append((k, " ".join(words[k * 12 : k * 12 + 150])))
    centre = [f"c{i}" for i in range(200)]
    data.append((100, " ".join(centre)))
    for k in range(30):
        w = list(centre)
        for j in range(6):
            w[(k * 6 + j * 31) % 200] = f"x{k}-{j}"
        data.append((101 + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == components([(a, b) for a, b in data])


def test_near_duplicates_null_ids_and_empty(spark):
    data = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f")]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (1, 1, True), (3, 1, False)]
    assert neardup.near_duplicates(none(spark)).count() == 0


# op2

def test_licenses(spark, corpus):
    plain = corpus.select("doc_id", "text")
    extra = spark.createDataFrame([(900, "some text here.\nReleased under the MIT License.\nmore"), (901, "Licensed under the Apache License, Version 2.0."), (902, "the driver's license was lost on the road to the lake"), (903, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    both = plain.unionByName(extra)
    got = unique(licenses.scan(both, licenses.train(both)).collect())
    assert (got[900].license, got[901].license, got[902].license) == ("mit", "apache-2.0", None)
    assert got[903].licenses == ["cc-by-nc", "gpl"]
    assert all(got[k].license is None and got[k].n_paragraphs == 0 for k in range(60))
    assert licenses.scan(none(spark), licenses.train(none(spark))).count() == 0


# op3

def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in order if s not in fixed)
        share = {s: fixed.get(s, left * weight[s] / w if w else 0.0) for s in order}
        over = [s for s in order if s not in fixed and share[s] > 3 * sizes[s]]
        if not over:
            return share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark, corpus):
    size, source = {}, {}
    sizes = Counter()
    for r in rows():
        size[r[0]], source[r[0]] = len(WORD.findall(r[1] or "")), r[3]
        sizes[r[3]] += size[r[0]]
    want = targets(sizes)
    got = mixing.mix_report(corpus).collect()
    assert len(got) == len(rows())
    taken, biggest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r["size"]
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in sizes)
    again = mixing.mix_report(corpus.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    out = mixing.mix(corpus)
    assert out.columns == [c for c in corpus.columns if c != "copies"] + ["copies"]
    words = Counter()
    for r in out.collect():
        words[r.source] += r.copies * size[r.doc_id]
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix_report(none(spark)).count() == 0


def test_mixing_caps_small_sources(spark):
    data = [(i, "w " * 10, "big") for i in range(100)] + [(1000, "w " * 5, "tiny"), (1001, None, "void")]
    got = mixing.mix_report(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    by = {("void" if r.doc_id == 1001 else "tiny" if r.doc_id == 1000 else "big"): r.target for r in got}
    assert by == pytest.approx({"tiny": 15.0, "void": 0.0, "big": 990.0})
    assert {r.taken for r in got if r.doc_id >= 1000} == {15, 0}


# op4

def test_suffixes(spark, corpus):
    seen, texts = Counter(), [(r[0], (r[1] or "").encode()) for r in rows()]
    for _, b in texts:
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    got = unique(suffixes.dedup(corpus, with_bytes=True).collect())
    for k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(r.kept) == kept
    assert suffixes.dedup(none(spark)).count() == 0


def test_difference_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


# op5

def test_substrings(spark, corpus):
    seen, want = set(), {}
    data = sorted(rows(), key=lambda r: r[0])
    for r in data:
        words = WORD.findall(r[1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.setdefault(r[0], []).append((len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = defaultdict(list)
    for r in substrings.dedup(corpus, with_text=True).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert substrings.dedup(none(spark)).count() == 0


def test_units_hold_any_text(spark):
    data = [(i, "x" * (50 * i)) for i in range(100)] + [(None, None)]
    packed = units.pack(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text", 1000).collect()
    assert sorted((i is None, i or 0) for r in packed for i in r.ids) == sorted((a is None, a or 0) for a, _ in data)
    assert len({r.unit for r in packed}) == len(packed) > 5


# op6

def test_language(spark, corpus):
    names, model = language_id.learn(corpus.where("lang is not null and text is not null").select("text", "lang"))
    got = unique(language_id.identify(corpus, names, model).collect())
    for r in rows():
        if 30 <= r[0] < 44 or r[0] in (20, 21, 22, 23, 24):
            continue
        if r[2]:
            assert got[r[0]].lang_pred == r[2]
    assert [got[k].lang_pred for k in (34, 35, 36, 37, 38)] == ["und"] * 5
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[44].lang_pred == "en"
    names, model = language_id.learn(none(spark).select("text", "lang"))
    assert {r.lang_pred for r in language_id.identify(corpus, names, model).collect()} == {"und"}
    assert language_id.identify(none(spark), names, model).count() == 0


def test_language_mixture(spark, corpus):
    names, model = language_id.learn(corpus.where("lang is not null and text is not null").select("text", "lang"))
    data = {r[0]: r[1] for r in rows()}
    text = (data[2] + " " + data[3][: len(data[2]) // 3]).encode()
    best, score, shares = language_id.infer(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model)
    assert names[best[0]] == "de" and 0.55 < score[0] < 0.95
    assert shares[0, best[0]] == score[0] and abs(shares.sum() - 1) < 1e-6


def test_language_sets(spark):
    """A text of five languages gets all five and their proportions, whatever stands beside it in the table."""
    alphabets = {"a": "abcd", "b": "efgh", "c": "ijkl", "d": "mnop", "e": "qrst", "f": "uvwx"}

    def words(lang, n):
        letters = alphabets[lang]
        return " ".join("".join(letters[(i * 7 + j * 3 + i // 4) % 4] for j in range(4 + i % 3)) for i in range(n))

    names, model = language_id.learn(spark.createDataFrame([(words(x, 400), x) for x in alphabets], "text string, lang string"))
    mixed = " ".join(words(x, n) for x, n in zip("abcde", (200, 160, 120, 80, 40), strict=True))
    data = [(1, mixed), (2, words("f", 50)), (3, None), (4, " 12 !"), (5, mixed)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), names, model).collect()}
    assert got[1].langs == list("abcde") and got[1][1:] == got[5][1:]
    assert all(abs(x - y) < 0.03 for x, y in zip(got[1].shares, (1 / 3, 4 / 15, 1 / 5, 2 / 15, 1 / 15), strict=True))
    assert (got[2].langs, got[2].lang_pred) == (["f"], "f")
    assert [(got[k].langs, got[k].shares, got[k].lang_pred, got[k].score) for k in (3, 4)] == [([], [], "und", 0.0)] * 2


# op7

def chunked(text):
    """A document's chunks as texts with their line feeds, by the operator's own boundaries."""
    data = np.frombuffer(text.encode(), np.uint8)
    c = lines.Chunks(data, np.array([0, len(data)]))
    assert b"".join(data[a:b].tobytes() for a, b in zip(c.start, c.end, strict=True)) == text.encode()
    return [(data[a:b].tobytes(), data[a:t].tobytes(), n) for a, b, t, n in zip(c.start, c.end, c.trimmed, c.lines, strict=True)]


def test_lines(spark, corpus):
    first, want = {}, {}
    for r in sorted(rows(), key=lambda r: r[0]):
        if r[1] is None:
            want[r[0]] = None
            continue
        kept = b""
        for k, (whole, body, n) in enumerate(chunked(r[1])):
            if n < lines.MIN_LINES or first.setdefault(body, (r[0], k)) == (r[0], k):
                kept += whole
        want[r[0]] = kept.decode()
    got = unique(lines.dedup_lines(corpus, report=True).collect())
    assert {k: r.text for k, r in got.items()} == want
    assert got[20].text != rows()[20][1] and got[20].chunks_removed > 0
    assert got[4].text == rows()[4][1]
    assert lines.dedup_lines(corpus).columns == corpus.columns
    assert lines.dedup_lines(none(spark)).count() == 0
    lone = spark.createDataFrame([(None, "a a\nb b\nc c\nd d"), (None, "a a\nb b\nc c\nd d")], "doc_id long, text string")
    assert {r.text for r in lines.dedup_lines(lone).collect()} == {"a a\nb b\nc c\nd d"}


def test_repeated_runs_go_whole(spark):
    rng = random.Random(4)
    fresh = lambda n: [prose(rng, 12) + f" {rng.random()}" for _ in range(n)]
    runs = [fresh(2 + i % 7) for i in range(21)]
    runs[3].insert(1, "")
    texts = [[*fresh(5), *r, *fresh(4)] for r in runs + runs[::-1]] + [runs[0] + runs[1], ["", "one line alone"], ["one line alone", ""]]
    seen, want = set(), {}
    for d, text in enumerate(texts):
        at = [i for i, x in enumerate(text) if x.strip()]
        gone = set()
        for a, b in zip(at, at[1:]):
            body = "\n".join(text[a : b + 1])
            if body in seen:
                gone.update(range(a, b + 1))
            seen.add(body)
        want[d] = [x for i, x in enumerate(text) if i not in gone]
    assert all(len(want[21 + i]) == 9 for i in range(21))
    every = spark.createDataFrame([(d, "\n".join(t) + "\n") for d, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in lines.dedup_lines(every, kind=lines.Pairs).collect()}
    assert got == {d: "".join(x + "\n" for x in t) for d, t in want.items()}


def test_chunks_resist_shifts():
    body = "\n".join(f"line number {i} of the text" for i in range(200))
    moved = {c[1] for c in chunked("a new first line\n" + body)}
    assert sum(c[1] in moved for c in chunked(body)) >= len(chunked(body)) - 3


# op8

def test_quality_classifier(spark, corpus):
    more = spark.createDataFrame([(1000 + i, *rows(seed=5)[i % 30][1:]) for i in range(300)], SCHEMA)
    junk = spark.createDataFrame([(2000 + i, ("AA!! BB!! CCC!! " if i % 2 else "ab*** cd$$$ ") * (20 + i), None, None, None, None, None, None, None, None) for i in range(30)], SCHEMA)
    every = corpus.unionByName(more).unionByName(junk)
    model = quality_classifier.train(every)
    got = unique(quality_classifier.score(every, model).collect())
    assert all(got[1000 + i].kept for i in range(300))
    assert not any(got[2000 + i].kept for i in range(30))
    assert not any(got[k].kept for k in (34, 35, 36, 37, 39, 41))
    kept = quality_classifier.good_documents(every)
    assert kept.columns == every.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert quality_classifier.score(none(spark), quality_classifier.train(none(spark))).count() == 0


# op9

def test_quality_rules(spark, corpus):
    got = unique(quality_rules.judge(corpus).collect())
    for r in rows():
        text = r[1] or ""
        words = WORD.findall(text)
        triples = Counter(zip(words, words[1:], words[2:]))
        repeat = {j for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        o = got[r[0]]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat))
        assert o.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert not (o.kept and o.base_failed)
    assert all(got[k].kept for k in range(20) if not got[k].base_failed)
    assert quality_rules.judge(none(spark)).count() == 0


def estimate_plainly(votes, n, rounds):
    prior, k = 0.85, votes.shape[1]
    table = {y: np.tile(quality_rules.START[y], (k, 1)) for y in ("good", "bad")}
    pseudo = max(1.0, 0.02 * n.sum())
    at = np.select([votes == 1, votes == -1], [0, 1], 2)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + np.log(table["good"] / table["bad"])[np.arange(k), at].sum(1)
        good = n / (1 + np.exp(-odds))
        for y, part in (("good", good), ("bad", n - good)):
            mass = np.stack([((at == i) * part[:, None]).sum(0) for i in range(3)], 1) + pseudo * np.array(quality_rules.START[y])
            p = mass / mass.sum(1, keepdims=True)
            if y == "good":
                over = p[:, 1] > quality_rules.WRONG
                scale = (1 - quality_rules.WRONG) / (1 - p[over, 1])
                p[over] *= scale[:, None]
                p[over, 1] = quality_rules.WRONG
            table[y] = p
        prior = min(0.99, max(0.5, good.sum() / n.sum()))
    return prior, table


def test_estimate_is_expectation_maximisation(spark):
    rng = np.random.default_rng(3)
    votes = np.unique(rng.choice([1, 1, 1, 0, -1], (40, len(quality_rules.RULES))), axis=0)
    n = rng.integers(1, 50, len(votes))
    frame = spark.createDataFrame([([int(x) for x in v], int(c)) for v, c in zip(votes, n, strict=True)], "votes array<int>, n long")
    prior, good, bad = quality_rules.estimate(frame, rounds=6)
    want, table = estimate_plainly(votes, n.astype(float), 6)
    assert prior == pytest.approx(want)
    assert np.allclose(good, table["good"]) and np.allclose(bad, table["bad"])


# op10

def test_decontamination(spark, corpus):
    data = {r[0]: r[1] for r in rows()}
    items = [(i, " ".join(f"q{i}w{j} the" for j in range(14))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    para = items[3][1].split()
    for j in (5, 11, 17):
        para[j] = "other"
    leaks = [(500, data[8] + " " + items[0][1] + " " + data[9]), (501, items[1][1].upper() + "!"), (502, data[12] + "\n" + " ".join(para)), (503, data[40] + items[2][1] + data[40]), (504, "two items " + items[5][1] + " " + items[6][1])]
    every = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(leaks, "doc_id long, text string"))
    got = unique(decontamination.contamination(every, bench).collect())
    assert {k: r.item_id for k, r in got.items() if r.contaminated and k < 504} == {500: 0, 501: 1, 502: 3, 503: 2}
    assert got[504].n_items == 2 and got[504].item_id == 5
    clean = decontamination.clean_documents(corpus, bench)
    assert clean.columns == corpus.columns and clean.count() == corpus.count()
    assert decontamination.contamination(none(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(every, bench.where("false")).collect())


def test_decontamination_recalls_what_brute_force_finds(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(15, 59))) for i in range(8)]
    texts = [prose(rng, 4000) + " " + items[i][1] + " " + prose(rng, 4000) if i < 7 else prose(rng, 8000) for i in range(12)]  # long
    texts += [prose(rng, 20) + " " + items[7][1] + " " + prose(rng, 20) if i < 80 else prose(rng, 60) for i in range(110)]  # a hot group
    words = [" ".join(["", *t.replace(".", " ").split(), ""]) for t in texts]
    held = {k for k, t in enumerate(words) if any(" ".join(["", *x.replace(".", " ").split(), ""]) in t for _, x in items)}
    assert len(held) == 87
    every = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = unique(decontamination.contamination(every, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert {k for k, r in got.items() if r.contaminated} == held


def test_decontamination_of_short_items_and_scripts_without_spaces(spark):
    items = [(0, "Who wrote it? Nobody."), (1, "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"), (2, "กรุงเทพมหานคร"), (3, "日本語")]
    texts = ["They asked: who wrote it -- nobody, it seems", "he wrote it and nobody knew who", "诗曰:春眠不觉晓处处闻啼鸟夜来风雨声花落知多少。完", "ไปกรุงเทพมหานครกัน", "the日本語text", "日 and 本語", "鸟落花知声雨多少"]
    every = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = unique(decontamination.contamination(every, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert {k: r.item_id for k, r in got.items() if r.contaminated} == {0: 0, 2: 1, 3: 2, 4: 3}


def test_common_subsequence():
    item = [1, 2, 3, 4, 5, 3]
    assert decontamination._lcs(item, decontamination._masks(item), [2, 9, 3, 5, 5, 3, 1]) == 4
    assert decontamination._lcs(item, decontamination._masks(item), []) == 0


# helpers

def test_winnowing_leaves_no_window_empty():
    h = bs.mix(np.random.default_rng(0).integers(0, 60, 4000).astype(np.uint64))
    mask = np.zeros(len(h), bool)
    mask[bs.winnow(h, 13)] = True
    for i in range(len(h) - 12):
        assert (h[i : i + 13][mask[i : i + 13]] == h[i : i + 13].min()).any()


# edge cases of units

TEXTLESS = [(51, "short"), (52, None), (53, ""), (None, "x y"), (55, "a few words only")]


def unique_texts():
    rng = random.Random(5)
    return [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(500))) for i in range(8)]


@pytest.mark.parametrize("data", [TEXTLESS, unique_texts(), [*unique_texts(), *TEXTLESS, (90, unique_texts()[3][1]), (91, "same words here " * 60)]], ids=["short", "unique", "some"])
def test_units_without_repeats(spark, data):
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    texts = [(i, (t or "").encode()) for i, t in data]
    seen = Counter(b[k : k + 400] for _, b in texts for k in range(len(b) - 399))
    got = {r.doc_id: r for r in suffixes.dedup(frame).collect()}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        assert (got[i].n_bytes, got[i].n_removed) == (len(b), sum(gone))
        assert got[i].kept_sha256 == hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(frame).collect()}
    known, want = set(), {}
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in known:
                gone.update(range(k, k + 20))
            known.add(tuple(w[k : k + 20]))
        want[i] = (len(w), len(gone))
    assert words == want


def test_many_units_and_slices(spark, monkeypatch):
    data = [(i, r[1]) for i, r in enumerate(rows(seed=3))]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(units.stored, "__defaults__", (3000,))
    texts = [(i, (t or "").encode()) for i, t in data]
    seen = Counter(b[k : k + 400] for _, b in texts for k in range(len(b) - 399))
    got = {r.doc_id: r.n_removed for r in suffixes.dedup(frame).collect()}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        assert got[i] == sum(gone)


def test_repeats_of_two_periods_show(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(2 * suffixes.PERIOD - 1))
    fresh = lambda n: "".join(rng.choice("klmnopqrst ") for _ in range(n))
    data = [(i, fresh(200 + 7 * i) + (shared if i < 6 else "") + fresh(300)) for i in range(12)]
    got = {r.doc_id: r for r in suffixes.dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all((got[i].n_repeated_tuples > 0) == (i < 6) and got[i].n_removed == 0 for i in range(12))


def test_ids_that_are_no_integers(spark):
    frame = spark.createDataFrame([("a", "some words"), ("b", "some words")], "doc_id string, text string")
    for op in (suffixes.dedup, substrings.dedup):
        with pytest.raises(TypeError, match="integers"):
            op(frame)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None)], "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_unit_numbers_are_of_their_bucket(spark):
    for task, buckets in ((0, 7), (5, 12), (40, 12)):
        numbers = units.numbers(task, buckets)
        some = [next(numbers) for _ in range(20)]
        found = spark.createDataFrame([(x,) for x in some], "x long").selectExpr(f"pmod(hash(x), {buckets}) AS b").distinct().collect()
        assert [r.b for r in found] == [task % buckets] and len(set(some)) == 20


def test_units_of_one_task_fill_many_buckets(spark):
    frame = spark.createDataFrame([(i, "some words of a text " * 20) for i in range(60)], "doc_id long, text string").coalesce(1)
    stored = units.stored(frame, "doc_id", "text", "dealt_units", 3000)
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = stored.selectExpr("unit", f"pmod(hash(unit), {buckets}) AS b").collect()
    assert len({r.unit for r in found}) == len(found) >= 8 and len({r.b for r in found}) == buckets
    share = [sum(r.b == b for r in found) for b in range(buckets)]
    assert max(share) - min(share) <= 1


# notices as they stand in files

def test_wrapped_strange_and_denied_notices(spark, corpus):
    import textwrap

    notice = {f: licenses.TEMPLATES[f][k] for f, k in (("mit", 2), ("bsd", 0), ("gpl", 1), ("isc", 1))}
    want = {f"{f} {w}": (textwrap.fill(t, w), f) for f, t in notice.items() for w in (40, 60, 500)}
    want |= {f"{f} amid": ("words that stand before it\n" + textwrap.fill(t, 60) + "\nand closing words after it", f) for f, t in notice.items()}
    strange = ["Licensed under the EUPL, Version 1.2 or later", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Frobnicate License, Version 7.0.", "Released under the Quux License.", "This work is not licensed under the MIT License.", "This work is not\nlicensed under the MIT License.", "the driver's license was lost"]
    want |= {s: (s, None) for s in strange}
    names = list(want)
    frame = spark.createDataFrame([(i, want[n][0]) for i, n in enumerate(names)], "doc_id long, text string")
    model = licenses.train(corpus.select("doc_id", "text"))
    got = {names[r.doc_id]: r.license for r in licenses.scan(frame, model).collect()}
    assert got == {n: x[1] for n, x in want.items()}


def test_window_scores_are_those_of_their_lines():
    p = licenses._paragraphs([b"one two three\nfour five\n\nsix seven\neight"])
    assert p.windows(2).tolist() == [0, 2] and p.windows(3).tolist() == []
    table = np.random.default_rng(1).standard_normal((licenses.DIMS, 3)).astype(np.float32)
    got = p.scores(table, np.zeros(3), p.windows(2), 2)
    lines = [sum(table[d].sum(0) for d in p.dims[p.first[i] : p.first[i] + p.n[i]]) for i in range(4)]
    assert np.allclose(got, [(lines[0] + lines[1]) / np.sqrt(10), (lines[2] + lines[3]) / np.sqrt(6)], atol=1e-4)


# clashing ids, several parts of a benchmark

def test_lines_of_clashing_ids(spark):
    long = "\n".join(f"line {i} of the first text" for i in range(40))
    data = [(1, long), (1, "short"), (2, long), (2, long + "\nand more\nand yet more"), (None, long)]
    for kind in (lines.Chunks, lines.Pairs):
        got = Counter((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"), kind=kind).collect())
        assert got[1, long] == 1 and got[1, "short"] == 1 and got[None, long] == 1
        assert sum(got.values()) == 5 and all(len(t) < len(long) for (i, t), _ in got.items() if i == 2)
    with pytest.raises(TypeError, match="integers"):
        lines.dedup_lines(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_benchmark_in_parts_gives_a_row_a_row(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(6)]
    docs = [(1, prose(rng, 30) + " " + items[0][1]), (1, prose(rng, 30) + " " + items[0][1]), (None, items[5][1]), (2, items[4][1] + " " + items[1][1]), (3, prose(rng, 40)), (4, None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontamination.contamination(frame, bench).collect()))
    monkeypatch.setattr(decontamination, "MAX_ITEM_BYTES", 200)
    parts = decontamination.contamination(frame, bench).collect()
    assert sorted(map(str, parts)) == whole and len(parts) == 6
    assert sorted((r.doc_id or -1, r.n_items, r.item_id) for r in parts if r.contaminated) == [(-1, 1, 5), (1, 1, 0), (1, 1, 0), (2, 2, 1)]


def test_buckets_follow_the_text_and_not_its_bytes_in_the_file(spark, monkeypatch, tmp_path):
    data = [(i, "the same words " * 700) for i in range(60)]  # 630,000 bytes that a file holds as one text
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(units, "BUCKET_BYTES", 40_000, raising=False)
    stored = units.stored(spark.read.parquet(str(tmp_path / "d")), "doc_id", "text", "equal_units", 20_000)
    held = stored.groupBy(F.input_file_name().alias("file")).agg(F.sum("total").alias("n")).collect()
    assert sum(r.n for r in held) == 60 * 15 * 700 and len(held) >= 15 and max(r.n for r in held) <= 80_000
