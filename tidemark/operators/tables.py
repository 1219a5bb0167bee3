"""Comparison tables: margins, intervals, giveaway slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.context import ABSENT, SHARED, UNIQUE
from tidemark.operators.families import against_strongest, pairs_with_control, strongest_floor
from tidemark.operators.ordered import durable
from tidemark.operators.scoring import confusion_counts, count_metrics, long_metrics
from tidemark.operators.uncertainty import (
    cluster_bootstrap,
    fold_scores,
    paired_difference,
    shared_folds,
)

SUBSET_WORDS = {UNIQUE: "unique to a class", SHARED: "shared by classes", ABSENT: "not recorded"}


def family_margins(pairs: DataFrame, metrics: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Every member against its control on the folds both have, all families at once."""
    paired = shared_folds(fold_scores(metrics, metric), pairs)
    return paired_difference(paired, ["family", "model", "control"])


def family_intervals(
    predictions: DataFrame, n_classes: int | None = None, families: DataFrame | None = None, **settings
) -> DataFrame:
    """Each model's own score with the range its groups support, on the first repeat.

    With ``families``, which has ``family, model, classes``, every model is scored over the classes
    of its family, all of them in one job; else all models have ``n_classes``.
    """
    first = predictions.filter(F.col("repeat") == 0) if "repeat" in predictions.columns else predictions
    if families is None:
        return cluster_bootstrap(first, n_classes, **settings)
    sizes = families.select("family", "model", F.size("classes").alias("n_classes"))
    # One row for each model, sent to the predictions: models are few, and a shuffle would bring all
    # rows of one to a task.
    return cluster_bootstrap(first.join(F.broadcast(sizes), "model"), "n_classes", keys=["family", "model"], **settings)


def fold_metrics(predictions: DataFrame, families: DataFrame) -> DataFrame:
    """Count metrics of every model and split over the classes of the model's family, in long form."""
    sizes = families.select("family", "model", F.size("classes").alias("n_classes"))
    keys = ["family", "model", "repeat", "fold"]
    # Counted before the join, which would bring all rows of a model to one task, and once for all readers.
    counts = durable(confusion_counts(predictions, keys[1:])).join(sizes, "model")
    return long_metrics(count_metrics(counts, keys, "n_classes"), keys)


def overview(
    families: DataFrame,
    metrics: DataFrame,
    summary: DataFrame,
    silent: Sequence[str],
    metric: str = "macro_f1",
) -> DataFrame:
    """Every margin against the declared control and against the strongest floor."""
    floors = strongest_floor(families, summary, silent, metric)
    pairs = pairs_with_control(families).unionByName(against_strongest(families, floors))
    return family_margins(pairs, metrics, metric).withColumnRenamed("control", "floor")


def packed_outcomes(outcomes: DataFrame) -> DataFrame:
    """One row per item with its (field, outcome) pairs, as many as there are fields."""
    return outcomes.groupBy("item_id").agg(
        F.collect_list(F.struct("field", "outcome")).alias("__outcomes")
    )


def _with_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    joined = predictions.join(packed_outcomes(outcomes), "item_id", "left")
    fail = F.raise_error(
        F.concat(F.lit("no giveaway outcome for item "), F.col("item_id").cast("string"))
    )
    checked = F.when(
        F.col("__outcomes").isNull(), fail.cast("array<struct<field:string,outcome:string>>")
    ).otherwise(F.col("__outcomes"))
    return joined.withColumn("__outcomes", checked)


def bucket_predictions(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each prediction with the giveaway outcome of its item, per field.

    A prediction whose item has no outcome fails the job.
    """
    joined = _with_outcomes(predictions, outcomes)
    return joined.select(*predictions.columns, F.inline("__outcomes"))


def unbucketed(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions whose item has no outcome; must be empty."""
    return predictions.join(outcomes.select("item_id").distinct(), "item_id", "left_anti")


def ambiguity(predictions: DataFrame, outcomes: DataFrame, n_classes: int) -> DataFrame:
    """Each model scored where a field does and does not name the class.

    The macro average of a slice is over the classes present anywhere in the slice,
    not per fold. All fields, models and slices are scored in one job.
    """
    # An item's few splits travel as one short row for all models: they are gathered where they are,
    # so that the join with outcomes moves and sorts a row for each item.
    slim = predictions.select("item_id", F.struct("model", "repeat", "fold", "label", "prediction").alias("split"))
    packed = slim.groupBy("item_id").agg(F.array_sort(F.collect_list("split")).alias("__splits"))
    rows = _with_outcomes(packed, outcomes).select("__outcomes", F.posexplode("__splits").alias("at", "split"), "__splits")
    # Splits are sorted by model: an item is fresh at the first of a model.
    before = F.get("__splits", F.col("at") - 1)["model"]
    rows = rows.withColumn("at", F.when(before.eqNullSafe(F.col("split.model")), 1).otherwise(0))
    rows = rows.select("at", "split.*", F.inline("__outcomes"))
    by = ["field", "model", "outcome"]
    split = [*by, "repeat", "fold"]
    # An item is distinct in its slice once, at the first of its model's splits.
    counts = durable(
        rows.groupBy(*split, "label", "prediction").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("fresh")
        )
    )
    slices = counts.groupBy(*by).agg(
        F.collect_set("label").alias("present"), F.sum("fresh").alias("items")
    )
    scored = count_metrics(counts.join(slices, by), split, n_classes, scored="present")
    folds = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("macro_f1").alias("macro_f1_mean"),
        F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("macro_f1_std"),
    )
    words = F.create_map(*[F.lit(x) for pair in SUBSET_WORDS.items() for x in pair])
    return (
        folds.join(slices, by).select(
            "field",
            "model",
            F.concat_ws(" ", "field", words[F.col("outcome")]).alias("subset"),
            "items",
            F.size("present").cast("bigint").alias("classes_scored"),
            F.lit(n_classes).cast("bigint").alias("classes_total"),
            "folds",
            "macro_f1_mean",
            "macro_f1_std",
        )
    )


def ambiguity_matrix(table: DataFrame, subsets: Sequence[str]) -> DataFrame:
    """Model by subset means."""
    return table.groupBy("model").pivot("subset", list(subsets)).agg(F.first("macro_f1_mean"))
