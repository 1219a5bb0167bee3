"""Result sets on shared storage: partitioned writes, scans, portable precision."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import MissingResults

# Decimal places of a table, significant figures of a p or q value.
DECIMALS = 10
SIGNIFICANT = 6
SIGNIFICANT_COLUMNS = ("p_value", "q_value")
PARTITIONS = ("config", "model")


def to_decimals(value: Column, places: int = DECIMALS) -> Column:
    """Round half to even at a number of decimals."""
    scale = F.lit(10.0**places)
    return F.rint(value * scale) / scale


def to_significant(value: Column) -> Column:
    """Ten decimals, or as many more as six significant figures need."""
    magnitude = F.floor(F.log10(F.abs(value)))
    places = F.when(value == 0, DECIMALS).otherwise(SIGNIFICANT - 1 - magnitude)
    scale = F.pow(F.lit(10.0), F.greatest(places, F.lit(DECIMALS)).cast("double"))
    return F.rint(value * scale) / scale


def rounded_table(df: DataFrame) -> DataFrame:
    """Floating columns at portable precision; text and integers untouched."""
    return df.withColumns(
        {
            name: to_significant(F.col(name))
            if name in SIGNIFICANT_COLUMNS
            else to_decimals(F.col(name))
            for name, kind in df.dtypes
            if kind in ("double", "float")
        }
    )


def write_rounded(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = rounded_table(df).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_items(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """Persist a table, partitioned by those of ``config, model`` that it has.

    Only the partitions that ``df`` has are replaced; other models' results stay.
    """
    there = [name for name in partitions if name in df.columns]
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*there).parquet(path)


def scan_results(
    spark: SparkSession,
    path: str,
    *,
    config: str | None = None,
    models: Sequence[str] | None = None,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Result sets of many models as one table; unwanted partitions are never opened.

    With ``summaries``, which has ``config`` and ``model`` of every finished result set,
    sets that are still being written do not count.
    """
    df = spark.read.parquet(path)
    if config is not None:
        df = df.filter(F.col("config") == config)
    if models is not None:
        df = df.filter(F.col("model").isin(list(models)))
    if summaries is not None:
        df = df.join(summaries.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi")
    return df


def result_names(results: DataFrame) -> DataFrame:
    """``(config, model)`` pairs that wrote results; answered from partition values."""
    return results.select("config", "model").distinct()


def gather_margins(tables: dict[str, DataFrame], expected: Sequence[str]) -> DataFrame:
    """Every configuration's margins in one frame; a missing configuration is an error."""
    missing = sorted(set(expected) - set(tables))
    if missing:
        raise MissingResults(f"no margins for {missing}")
    tagged = [tables[name].withColumn("config", F.lit(name)) for name in expected]
    return reduce(DataFrame.unionByName, tagged)
