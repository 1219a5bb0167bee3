"""Listing media files with Spark; the bytes are never read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_listing(
    spark: SparkSession, root: str, classes: Sequence[str] | None = None, pattern: str = "*.wav"
) -> DataFrame:
    """``(relative_path, bytes)`` of every matching file below the chosen class folders."""
    roots = [root] if classes is None else [f"{root}/{name}" for name in classes]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(roots)
    )
    base = F.lit(root.rstrip("/") + "/")
    path = F.col("path")
    start = F.instr(path, base) + F.length(base)
    return files.select(
        F.substring(path, start, F.length(path)).alias("relative_path"),
        F.col("length").alias("bytes"),
    )
