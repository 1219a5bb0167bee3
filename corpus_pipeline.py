"""A cleaning pipeline over ``documents``: five of the operators of ``tidemark.llm`` in order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last return the
columns of ``documents``. A filtering stage works on every row its predecessor kept: it is
fitted on the labels of those rows and on nothing else. Null texts count as empty, and are
scored, kept or dropped like other texts; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import drop_exact
from tidemark.llm.minhash import drop_near
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import drop_low_quality
from tidemark.llm.toxicity import drop_toxic
from tidemark.operators.ordered import durable


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose restored text scores as toxic."""
    return drop_toxic(docs, _labels(spark, sf_dir))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose statistics score as low quality."""
    return drop_low_quality(docs, _labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of identical texts: the largest id."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: the smallest id."""
    return drop_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences of 4096 tokens: one row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", pack),
]

#: Fitted models and token ids are beyond SQL; a test holds ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read from what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
