"""Grouped cross validation: fit per fold, predict, roll up, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import TidemarkError
from tidemark.operators import models, scoring
from tidemark.operators.ordered import durable
from tidemark.operators.splits import check_folds, item_parts, items_from_windows
from tidemark.operators.windows import extract_complete
from tidemark.parameters import Split
from tidemark.sources.sets import commit_set


def fold_pairs(split: Split) -> list[tuple[int, int]]:
    return [(r, f) for r in range(split.repeats) for f in range(split.n_folds)]


def folds_for(windows: DataFrame, split: Split) -> DataFrame:
    """Item parts over the items that produced windows, never over those that did not."""
    return item_parts(
        items_from_windows(windows),
        n_folds=split.n_folds,
        repeats=split.repeats,
        seed=split.seed,
        validation_splits=split.validation_splits,
    )


def planned_windows(
    windows: DataFrame, split: Split, kept: DataFrame | None = None, folds: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The checked folds (those given, if any), and the windows written once with their plan.

    Folds that part a group or leave an item out are refused, and so are kept items without
    windows, and windows that the plan does not know.
    """
    if kept is not None:
        extract_complete(kept, windows)
    items = durable(items_from_windows(windows))
    folds = durable(folds_for(items, split)) if folds is None else folds
    check_folds(items, folds, split.repeats * split.n_folds)
    return folds, models.with_plan(windows, folds, fold_pairs(split))


def cross_validate(
    windows: DataFrame,
    class_names: Sequence[str],
    fit: models.Fit,
    split: Split,
    model: str,
    *,
    ranking: bool = True,
    kept: DataFrame | None = None,
    folds: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Predictions and metrics of one model over every (repeat, fold).

    ``windows`` has ``item_id, group_id, class, label, window_index, features``. The windows
    are written once, with the part of their item in every split; models, predictions
    and scores stay distributed. With ``kept``, items that produced no window fail the plan.
    With ``folds`` of an earlier run both runs have the same splits.
    """
    folds, planned = planned_windows(windows, split, kept, folds)
    pairs = fold_pairs(split)
    fitted = models.fit_folds(planned, folds, fit, len(class_names), pairs)
    scored = durable(models.predict_folds(planned, folds, fitted, model).drop("features"))
    covered = scored.select("repeat", "fold").distinct().count()
    if covered < len(pairs):
        raise TidemarkError(f"{len(pairs) - covered} folds have no test windows")
    items = scoring.roll_up_windows(scored, len(class_names))
    metrics = scoring.score_folds(items, class_names, ranking=ranking)
    marked = scored.withColumn("prediction", scoring.predicted_class(F.col("probs")))
    return {
        "fitted": fitted,
        "folds": folds,
        "predictions": items,
        "window_predictions": scoring.window_predictions(scored),
        "metrics": metrics,
        "window_metrics": scoring.score_folds(marked, class_names, ranking=ranking),
        "summary": scoring.summarise_folds(metrics),
        "confusion": scoring.confusion(
            scoring.confusion_counts(items, ["model", "repeat", "fold"]), class_names
        ),
    }


SAVED = ("predictions", "window_predictions", "metrics", "window_metrics", "confusion", "summary")


def save_result(
    done: dict[str, DataFrame],
    root: str,
    config: str,
    model: str,
    class_names: Sequence[str],
    facts: dict[str, object] | None = None,
) -> str:
    """Commit every table of a cross validation as one set, with what its labels mean."""
    return commit_set({name: done[name] for name in SAVED}, root, config, model, classes=class_names, facts=facts)
