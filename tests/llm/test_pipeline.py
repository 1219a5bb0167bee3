"""The pipeline against plain Python, stage by stage, and its corner cases."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import _near
from tidemark.llm import quality, toxicity
from tidemark.operators.ordered import durable

FOLDER = "/root/testdata/sf0.001"


def _near_five(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = " ".join(w.decode("utf-8", "ignore") for w in words)
    return _near(list(sets.items()), size=5, percent=80)


def test_run_equals_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    clean = toxicity.toxicity_scores(docs, labels).filter("predicted = 0").select("doc_id")
    kept = durable(docs.join(clean, "doc_id"))
    good = quality.quality_scores(kept, labels).filter("predicted = 1").select("doc_id")
    rows = [(r["doc_id"], r["text"]) for r in kept.join(good, "doc_id").collect()]
    last = {}
    for i, text in rows:
        last[text] = max(i, last.get(text, i))
    rows = sorted((i, text) for text, i in last.items())
    found = _near_five(rows)
    rows = [(i, text) for i, text in rows if found[i][1] == i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in rows:
        size = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        want.update((i, k, min(4096, size - 4096 * k)) for k in range(-(-size // 4096)))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == want and len(want) > 100


def test_stages_keep_columns_and_survive_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "a text without an id", "en", "s", 3),
            (3, "the same text twice", "en", "s", 1), (3, "the same text twice", "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = durable(stage(spark, docs, FOLDER))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert packed.count() == docs.count()
        assert docs.filter("doc_id = 3").count() <= 1
