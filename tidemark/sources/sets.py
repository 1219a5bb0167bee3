"""Sets of tables that become visible as a whole.

A set is one writing of some tables under a name ``(config, model)``. Its tables go into a folder
of their own; then one row is appended to ``commits``, whose file Spark moves into place as its
last act. Readers start from ``commits``, so a set that was killed while being written is
never seen, a newer version replaces an older one for readers at once, and whoever still
reads the older one keeps its files. Commits hold a row for each writing of a set.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import MissingResults
from tidemark.sources.results import PARTITIONS

COMMITS = (
    "config string, model string, version bigint, run string, tables array<string>, classes array<string>, facts string"
)


def commit_set(
    tables: Mapping[str, DataFrame],
    root: str,
    config: str,
    model: str,
    *,
    classes: Sequence[str] = (),
    facts: Mapping[str, object] | None = None,
) -> str:
    """Write the tables, then the commit that makes them a set; returns the run's name.

    ``classes`` says what the labels mean and ``facts`` whatever else belongs to the set.
    """
    spark = next(iter(tables.values())).sparkSession
    run = f"run-{uuid.uuid4().hex}"
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/sets/{run}/{name}")
    before = _commits(spark, root).filter((F.col("config") == config) & (F.col("model") == model))
    version = (before.agg(F.max("version")).head()[0] or 0) + 1
    row = (config, model, version, run, list(tables), list(classes), json.dumps(dict(facts or {}), sort_keys=True))
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return run


def _commits(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMITS).parquet(f"{root}/commits")
    except AnalysisException:
        return spark.createDataFrame([], COMMITS)


def committed(spark: SparkSession, root: str, config: str | None = None, models: Sequence[str] | None = None) -> DataFrame:
    """The newest version of every set: one row each. Of equal versions the last run by name counts."""
    found = _commits(spark, root)
    if config is not None:
        found = found.filter(F.col("config") == config)
    if models is not None:
        found = found.filter(F.col("model").isin(list(models)))
    newest = Window.partitionBy(*PARTITIONS).orderBy(F.desc("version"), F.desc("run"))
    return found.withColumn("__place", F.row_number().over(newest)).filter("__place = 1").drop("__place")


def read_sets(
    spark: SparkSession, root: str, table: str, *, config: str | None = None, models: Sequence[str] | None = None
) -> DataFrame:
    """One table of all committed sets, with ``config``, ``model`` and the set's ``classes``.

    Only the folders of the wanted sets are opened. A model that has no set is an error.
    """
    rows = committed(spark, root, config, models).collect()
    there = [row for row in rows if table in row["tables"]]
    missing = sorted(set(models or []) - {row["model"] for row in there})
    if missing or not there:
        raise MissingResults(f"no committed {table!r} of {missing or config or root}")
    parts = []
    for row in sorted(there, key=lambda r: (r["config"], r["model"])):
        frame = spark.read.parquet(f"{root}/sets/{row['run']}/{table}")
        named = {
            "config": F.lit(row["config"]),
            "model": F.lit(row["model"]),
            "classes": F.array(*[F.lit(c) for c in row["classes"]]).cast("array<string>"),
        }
        parts.append(frame.drop(*named).withColumns(named))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
