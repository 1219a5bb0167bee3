"""Reading a few columns out of wide parquet shards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

NOTE_COLUMNS = ("record_number", "display_name", "note", "location")


def scan_columns(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of the shards with only the named columns read from storage."""
    return spark.read.parquet(*paths).select(*columns)


def scan_notes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The text columns of the metadata shards, leaving the audio behind."""
    return scan_columns(spark, paths, NOTE_COLUMNS)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
