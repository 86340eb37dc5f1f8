"""Stages of the pipeline on ids that repeat, missing ids and empty tables."""

import os
import random

import corpus_pipeline as pipeline
from strikeline.llm import jaccard, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(1)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, b + " x"), (7, c), (None, c), (None, d), (None, d), (None, d + " y"), (8, None), (9, ""), (10, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k1 int").repartition(3)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [x for x in got if x[1] not in (d, d + " y")] == sorted([(3, a), (5, b), (7, c), (8, None), (9, ""), (10, None)], key=repr)
    assert len([x for x in got if x[1] in (d, d + " y")]) == 1
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([("i", "some words of a benchmark item that nobody has")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], DOC)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert (out.columns, out.count()) == (docs.columns, 0), name
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(2)
    planted, line = words(rng, 55), words(rng, 12)
    rows = [(k, f"{words(rng, 40)} {planted} {words(rng, 40)}") for k in range(4)] + [(10 + k, f"{words(rng, 60)} {line}") for k in range(4)] + [(20, " ".join([line] * 20)), (21, planted)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, "").collect()}
    assert all(planted not in got[k] and got[k].split()[:40] == rows[k][1].split()[:40] for k in range(4))
    assert all(got[i] == t for i, t in rows if 10 <= i <= 20) and 21 not in got


def test_only_the_last_result_stays(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    os.makedirs(f"{tmp_path}/shared")
    base = words(rng, 60, 300)
    rows = [(k, f"{words(rng, 80, 300)} the and of to in", "en", "s", 1) for k in range(20)] + [(30, base, "en", "s", 1), (31, base, "en", "s", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", words(rng, 12))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for module in (pipeline, vectors):
        monkeypatch.setattr(module, "shared_folder", lambda _: f"{tmp_path}/shared")
    out = pipeline.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().count() == 21
    left = os.listdir(f"{tmp_path}/shared")
    assert len(left) == 1 and left[0].startswith("pipeline-") and os.listdir(f"{tmp_path}/shared/{left[0]}") == ["4-sentence_pieces"]
