"""The result tables of one configuration, from predictions to margins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scoring, tables
from tidemark.operators.families import pairs_with_control
from tidemark.operators.ordered import durable
from tidemark.sources.results import rounded_table, write_rounded

HEADLINE = ["accuracy", "macro_f1", "weighted_f1"]


def build(
    predictions: DataFrame,
    families: DataFrame,
    class_names: Sequence[str],
    silent: Sequence[str],
    outcomes: DataFrame | None = None,
    *,
    resamples: int = 2000,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Named tables: overview, comparison, margin_over_control, intervals, ambiguity.

    The fold metrics, a few rows per split, are computed once and kept; every table
    covers all families and models in one job. ``families`` may carry ``classes``, a list for
    each family (``families.with_class_lists``); else all are scored over ``class_names``.
    """
    n_classes = len(class_names)
    if "classes" in families.columns:
        metrics = durable(tables.fold_metrics(predictions, families).drop("family"))
        intervals = tables.family_intervals(predictions, families=families, resamples=resamples, seed=seed)
    else:
        metrics = durable(scoring.score_folds(predictions, class_names, ranking=False))
        intervals = tables.family_intervals(predictions, n_classes, resamples=resamples, seed=seed)
    summary = scoring.summarise_folds(metrics)
    built = {
        "overview": tables.overview(families, metrics, summary, silent),
        "comparison": scoring.comparison(summary, HEADLINE),
        "margin_over_control": tables.family_margins(pairs_with_control(families), metrics),
        "intervals": intervals,
    }
    if outcomes is not None:
        built["ambiguity"] = tables.ambiguity(predictions, outcomes, n_classes)
    return built


def write(built: dict[str, DataFrame], folder: str) -> None:
    """One rounded table per name below the folder."""
    for name, frame in built.items():
        write_rounded(frame, f"{folder}/{name}")


def as_lines(built: dict[str, DataFrame]) -> DataFrame:
    """Every table as ``(table, line)`` with the row as JSON."""
    lines = [
        rounded_table(frame).select(
            F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("line")
        )
        for name, frame in built.items()
    ]
    return reduce(DataFrame.unionByName, lines)
