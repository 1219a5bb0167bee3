"""Session settings the operators are written for."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Skewed join partitions are split at run time, also where that adds a shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, for clusters where it is not installed."""
    folder = tempfile.mkdtemp(prefix="spark-")
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(folder, "tidemark"), "zip", os.path.dirname(package), "tidemark")
    spark.sparkContext.addPyFile(archive)
    return spark


def local_session(cpus: str = "*", partitions: int = 8, name: str = "tidemark") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    session = tune(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session
