import pytest
from corpus import none, rows

import corpus_pipeline
from corpusforge.llm import decontamination, lines, neardup, quality_classifier


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    data = [r[:5] for r in rows(n=60)] + [(200 + i, *rows(seed=9)[i % 30][1:5]) for i in range(90)]
    data.append((400, "lead in " + " ".join(f"q{j}w the" for j in range(20)) + " lead out " + " ".join(reversed(rows()[6][1].split())), "en", "s1", 10))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{j}w the" for j in range(20)))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, sf_dir, tmp_path):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        if name != "mix":
            assert docs.columns == start.columns
        kept[name] = docs.select("doc_id").collect()
        if name == "quality":
            want = quality_classifier.score(before, quality_classifier.train(before)).where("kept").collect()
            assert sorted(r.doc_id for r in want) == sorted(r.doc_id for r in kept[name])
        elif name == "line_dedup":
            want = {r.doc_id: r.text for r in lines.dedup_lines(before).collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_dedup":
            want = {r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()}
            assert {r.doc_id for r in kept[name]} == want
        elif name == "decontaminate":
            gone = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in kept[name]}
            assert gone == {r.doc_id for r in decontamination.contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()} == {400}
        else:
            assert {r.doc_id for r in kept[name]} <= {r.doc_id for r in kept["decontaminate"]}
            assert docs.where("copies < 1 or copies > 3").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "copies").collect())) == sorted(map(tuple, docs.select("doc_id", "copies").collect()))


def test_stages_of_an_empty_table_and_of_nulls(spark, sf_dir):
    for data in (none(spark), spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, 0), (2, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, data, sf_dir)
            if name != "mix":
                assert got.columns == data.columns
            assert got.count() == (0 if name in ("quality", "mix") else data.count())
