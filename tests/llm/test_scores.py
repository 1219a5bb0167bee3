"""Toxicity and quality: decoding, held-out accuracy, corner cases."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.trees import fit_forest
from tidemark.llm.words import buffers

FOLDER = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, score string"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def _held_out(scores, labels, name):
    rows = scores.join(labels, "doc_id").filter("held_out").select("score", "predicted", name).collect()
    return [r["predicted"] for r in rows], [r[name] for r in rows], [r["score"] for r in rows]


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    scores = quality.quality_scores(docs, labels)
    assert scores.count() == docs.count() and scores.filter("score < 0 or score > 1 or score is null").count() == 0
    said, true, _ = _held_out(scores, labels, "quality")
    assert sum(a == b for a, b in zip(said, true)) >= 0.98 * len(true)


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels = tables
    scores = toxicity.toxicity_scores(docs, labels)
    assert scores.count() == docs.count() and scores.filter("score < 0 or score > 1 or score is null").count() == 0
    said, true, _ = _held_out(scores, labels, "toxic")
    caught = sum(a for a, b in zip(said, true) if b) / max(sum(true), 1)
    wrong = sum(a for a, b in zip(said, true) if not b) / max(len(true) - sum(true), 1)
    assert caught >= 0.9 and wrong <= 0.02


def test_labels_of_held_out_rows_are_not_read(tables):
    from pyspark.sql import functions as F

    from tidemark.llm.rows import remainder

    docs, labels = tables
    few = docs.filter("doc_id < 1500")
    turned = labels.withColumn("quality", F.when(remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.quality_scores(few, which).orderBy("doc_id").collect() for which in (labels, turned))
    assert one == two


def test_disguised_words_are_restored():
    words = ["pathetic", "moron", "idiot", "trash", "worthless", "disgusting", "stupid", "the", "and", "others"] * 20
    texts = pa.array([" ".join(words)])
    counts = np.zeros((28,) * 3)
    part = next(toxicity._grams(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    counts.reshape(-1)[part.column("gram").to_numpy()] = part.column("n").to_numpy()
    single = counts.sum(axis=(0, 1)) + 1.0
    pair = (counts.sum(axis=0) + 20 * single / single.sum()) / (counts.sum(axis=0).sum(axis=1, keepdims=True) + 20)
    restorer = toxicity.Restorer(np.log((counts + 5 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 5)))
    reader = toxicity.Reader(np.zeros((28,) * 3))
    reader.restorer = restorer
    disguised = {
        "p4thetic": "pathetic", "m0r0n": "moron", "1d10t": "idiot", "tr@$h": "trash", "w0rthle$$": "worthless",
        "d1sgust1ng": "disgusting", "stuuupid": "stupid", "p.a.t.h.e.t.i.c": "pathetic", "m o r o n": "moron",
        "MORON!!": "moron", "(trash),": "trash", "id-iot": "idiot", "s t u p 1 d": "stupid",
    }
    for text, word in disguised.items():
        _, _, meaning = reader.tokens(*buffers(pa.array([f"the {text} others"])))
        assert word in {w for words in meaning for w in words}, text
    # Plain words have one path and stay as they are.
    assert restorer.token("others,") == {"others"} and restorer.token("") == set()


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_corner_cases_of_the_scores(spark, score):
    rows = [(1, None, "x"), (2, "", None), (3, "a " * 30000, ""), (3, "a " * 30000, ""), (None, "words of no id", ""), (4, "x" * 100000, "")]
    docs = spark.createDataFrame(rows, DOCS)
    for pairs in ([], [(1, None, None)], [(1, 1, 1), (2, 0, 0), (2, 1, 1), (None, 1, 0)], [(3, 1, 0), (4, 0, 1)]):
        labels = spark.createDataFrame(pairs, "doc_id bigint, quality int, toxic int")
        got = score(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert score(docs.limit(0), labels).count() == 0


def test_filters_keep_columns_and_rows_of_other_names(spark):
    docs = spark.createDataFrame([(1, "some plain words here", "a"), (2, None, "b")], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for drop in (toxicity.drop_toxic, quality.drop_low_quality):
        kept = drop(docs, labels)
        assert kept.columns == docs.columns and kept.count() in (0, 2)


def test_forest_learns_a_step_and_survives_one_label():
    draw = np.random.default_rng(4)
    rows = draw.normal(size=(2000, 3))
    label = ((rows[:, 0] > 0.3) ^ (rows[:, 1] > 0)).astype(float)
    forest = fit_forest(rows, label)
    assert ((forest.score(rows) > 0.5) == label).mean() > 0.97
    assert fit_forest(rows, np.ones(2000)).score(rows).min() > 0.9
    assert (fit_forest(rows[:0], label[:0]).score(rows) == 0.5).all()
    assert len(forest.score(rows[:0])) == 0
