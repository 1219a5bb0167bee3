"""Scores from predictions: roll-up, confusion counts, ranking metrics, summaries.

Frames are long. ``keys`` names the columns that identify one scored slice, such as
``(model, repeat, fold)``; every slice is scored in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking, resampling
from tidemark.operators.ordered import durable

COUNT_METRICS = ("accuracy", "macro_f1", "weighted_f1")
RANKING_METRICS = (ranking.AUC_NAME, ranking.AP_NAME)
SPLIT = ("model", "repeat", "fold")


def predicted_class(probs: Column) -> Column:
    """Argmax; the first class wins a tie."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def roll_up_windows(
    windows: DataFrame, n_classes: int, keys: Sequence[str] = SPLIT
) -> DataFrame:
    """Mean window scores per item, then argmax: an item counts once.

    Means are partial aggregates, so an item with very many windows is summed where
    its windows are. Group, class and label belong to the item and are part of the key.
    """
    means = [F.avg(F.col("probs")[k]).alias(f"__p{k}") for k in range(n_classes)]
    rolled = windows.groupBy(*keys, "item_id", "group_id", "class", "label").agg(*means)
    probs = F.array(*[F.col(f"__p{k}") for k in range(n_classes)])
    return (
        rolled.withColumn("probs", probs)
        .withColumn("prediction", predicted_class(F.col("probs")))
        .drop(*[f"__p{k}" for k in range(n_classes)])
    )


def widen_probs(df: DataFrame, n_classes: int, prefix: str = "p") -> DataFrame:
    """Class scores as columns ``p0..``, for export."""
    return df.select(
        *[c for c in df.columns if c != "probs"],
        *[F.col("probs")[k].alias(f"{prefix}{k}") for k in range(n_classes)],
    )


def confusion_counts(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, label, prediction, n)``: the only thing the count metrics need."""
    return predictions.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion(
    counts: DataFrame, class_names: Sequence[str], keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Every (actual, predicted) pair in class order, zeros included."""
    classes = F.sequence(F.lit(0), F.lit(len(class_names) - 1))
    grid = (
        counts.select(*keys)
        .distinct()
        .withColumn("label", F.explode(classes))
        .withColumn("prediction", F.explode(classes))
    )
    pooled = counts.groupBy(*keys, "label", "prediction").agg(F.sum("n").alias("n"))
    names = F.array(*[F.lit(name) for name in class_names])
    return grid.join(pooled, [*keys, "label", "prediction"], "left").select(
        *keys,
        names[F.col("label")].alias("actual"),
        names[F.col("prediction")].alias("predicted"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def class_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, class_index, correct, predicted, actual)`` for the classes that occur."""
    zero = F.lit(0)
    sides = F.array(
        F.struct(
            F.col("label").alias("class_index"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("c"),
            zero.alias("p"),
            F.col("n").alias("a"),
        ),
        F.struct(
            F.col("prediction").alias("class_index"),
            zero.alias("c"),
            F.col("n").alias("p"),
            zero.alias("a"),
        ),
    )
    return (
        counts.select(*keys, F.inline(sides))
        .groupBy(*keys, "class_index")
        .agg(
            F.sum("c").alias("correct"),
            F.sum("p").alias("predicted"),
            F.sum("a").alias("actual"),
        )
    )


def _over(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _f1() -> Column:
    return _over(2 * F.col("correct"), F.col("predicted") + F.col("actual"))


def count_metrics(
    counts: DataFrame, keys: Sequence[str], n_classes: int | str, scored: str | None = None
) -> DataFrame:
    """Accuracy, macro-F1 and weighted-F1 per slice, from the counts alone.

    A class that never occurs scores zero and still divides the macro average.
    ``n_classes`` may name a column of the counts (constant per slice), so that slices with
    different classes are scored in one job. ``scored`` may name an array column of the counts (constant per slice) with the
    class indices that enter the macro average instead.
    """
    keys = list(keys)
    carry = [] if scored is None else [scored]
    if isinstance(n_classes, str):
        carry.append(n_classes)
    per_class = class_counts(counts, [*keys, *carry]).withColumn("f1", _f1())
    if scored is None:
        macro = F.sum("f1") / (F.first(n_classes) if isinstance(n_classes, str) else F.lit(float(n_classes)))
    else:
        entering = F.array_contains(F.col(scored), F.col("class_index"))
        macro = _over(F.coalesce(F.sum(F.when(entering, F.col("f1"))), F.lit(0.0)), F.first(F.size(scored)))
    total = F.sum("actual")
    return per_class.groupBy(*keys, *carry).agg(
        _over(F.sum("correct"), total).alias("accuracy"),
        macro.alias("macro_f1"),
        _over(F.sum(F.col("f1") * F.col("actual")), total).alias("weighted_f1"),
        total.alias("n_items"),
    ).drop(*carry)


def per_class(counts: DataFrame, keys: Sequence[str], class_names: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class in every slice."""
    classes = F.sequence(F.lit(0), F.lit(len(class_names) - 1))
    grid = counts.select(*keys).distinct().withColumn("class_index", F.explode(classes))
    found = grid.join(class_counts(counts, keys), [*keys, "class_index"], "left").na.fill(
        0, ["correct", "predicted", "actual"]
    )
    names = F.array(*[F.lit(name) for name in class_names])
    return found.select(
        *keys,
        names[F.col("class_index")].alias("class"),
        _over(F.col("correct"), F.col("predicted")).alias("precision"),
        _over(F.col("correct"), F.col("actual")).alias("recall"),
        _f1().alias("f1"),
        F.col("actual").alias("support"),
    )


def ranking_metrics(
    predictions: DataFrame,
    keys: Sequence[str],
    n_classes: int,
    weight: str | None = None,
    draws: ranking.Draws | None = None,
    metric: str | None = None,
) -> DataFrame:
    """One-vs-rest ROC AUC and average precision, macro over the classes present.

    With absent classes, AUC drops their scores and renormalises each row; with exactly two
    present it is the one binary AUC; with fewer it is null, as is the average precision.

    With ``draws`` the result has a row for each ``resample`` too. ``predictions`` then has
    ``unit`` and ``groups``, the number of the row's group and how many its slice has; a row weighs
    as often as its group was drawn, and a class whose groups were not drawn is absent. ``metric``
    may name the one that is wanted; the other is null.
    """
    keys = list(keys)
    mass = F.col(weight) if weight else F.lit(1)
    # Slices are few; a number in place of their keys keeps the large rows fixed-width.
    slices = durable(
        predictions.groupBy(*keys)
        .agg(
            F.sort_array(F.collect_set("label")).alias("present"),
            F.count(F.lit(1)).alias("rows"),
            *([F.max("groups").alias("groups")] if draws else []),
        )
        .withColumn("slice", F.monotonically_increasing_id())
    )
    if draws is None:
        return _exact_ranking(predictions, slices, keys, n_classes, mass, metric)
    # Every class is in nearly all resamples: they are scored as if, and those that turn out to lack
    # one are scored again over the classes they have.
    numbers = F.sequence(F.lit(0), F.lit(draws.resamples - 1))
    scored = durable(
        _resampled_ranking(predictions, slices, keys, n_classes, mass, draws, metric, slices.withColumn("resamples", numbers))
    )
    lacking = scored.filter(~F.col("whole")).select("slice", "resample")
    if not lacking.isEmpty():
        few = slices.join(lacking.select("slice").distinct(), "slice", "left_semi")
        found = _present_in_resamples(predictions, few, keys, draws).join(lacking, ["slice", "resample"])
        some = found.groupBy("slice", "present").agg(F.array_sort(F.collect_list("resample")).alias("resamples"))
        some = some.join(slices.select("slice", "groups"), "slice")
        again = _resampled_ranking(predictions, slices, keys, n_classes, mass, draws, metric, some)
        scored = scored.filter("whole").unionByName(again)
    every = slices.select(*keys, "slice", F.explode(numbers).alias("resample"))
    return every.join(scored.drop("whole"), ["slice", "resample"], "left").drop("slice")


def _resampled_ranking(
    predictions: DataFrame,
    slices: DataFrame,
    keys: list[str],
    n_classes: int,
    mass: Column,
    draws: ranking.Draws,
    metric: str | None,
    scored: DataFrame,
) -> DataFrame:
    """``slice, resample`` with both metrics, and whether all classes of the view have one.

    ``scored`` has ``slice, groups, present, resamples``: the classes that those resamples are scored over.
    """
    views = durable(
        scored.filter(F.size("present") >= 2)
        .select("slice", "groups", "present", "resamples")
        .withColumn("kind", F.explode(ranking.view_kinds(F.col("present"), n_classes)))
        .withColumn("view", F.monotonically_increasing_id())
    )
    # A slice has few views: they travel as one short array. Spark sends the slices to the
    # rows while they are small, and else shuffles and splits what is skewed.
    packed = (
        views.groupBy("slice")
        .agg(F.collect_list(F.struct("view", "kind", "present")).alias("views"))
        .join(slices.select(*keys, "slice"), "slice")
    )
    rows = predictions.select(
        *keys,
        "label",
        "unit",
        mass.cast("bigint").alias("mass"),
        "probs",
    ).join(packed, keys)
    per_class = ranking.areas(ranking.entries(rows), views, draws, metric)
    auc, ap = F.when(F.col("kind") != ranking.AP, F.col("auc")), F.when(F.col("kind") != ranking.AUC, F.col("ap"))
    told = (
        per_class.join(views.select("view", "slice", "kind", F.size("present").alias("classes")), "view")
        .groupBy("slice", "resample")
        .agg(
            F.avg(auc).alias(RANKING_METRICS[0]),
            F.avg(ap).alias(RANKING_METRICS[1]),
            F.count(auc).alias("aucs"),
            F.count(ap).alias("aps"),
            F.max("classes").alias("classes"),
        )
    )
    # Of two classes there is one AUC.
    aucs = F.col("aucs") == F.when(F.col("classes") == 2, 1).otherwise(F.col("classes"))
    whole = (F.lit(metric == ranking.AP_NAME) | aucs) & (F.lit(metric == ranking.AUC_NAME) | (F.col("aps") == F.col("classes")))
    return told.withColumn("whole", whole).drop("aucs", "aps", "classes")


def _exact_ranking(
    predictions: DataFrame, slices: DataFrame, keys: list[str], n_classes: int, mass: Column, metric: str | None
) -> DataFrame:
    """The ranking metrics of every slice as it is; ``slices`` is one short row for each."""
    kinds = ranking.view_kinds(F.col("present"), n_classes)
    every = F.size(kinds) == 1
    views = slices.filter(F.size("present") >= 2).select(
        *keys,
        "slice",
        (F.col("slice") * 2).alias("view"),
        F.when(every, "").otherwise(F.array_join(F.col("present").cast("array<string>"), " ")).alias("present"),
    )
    most = slices.agg(F.max("rows")).first()[0] or 0
    slim = predictions.select(*keys, F.col("label").cast("int"), mass.cast("bigint").alias("mass"), "probs")
    rows = slim.join(views, keys).select("view", "present", "label", "mass", "probs")
    found = ranking.exact_areas(rows, n_classes, most, metric)
    # The second view of a slice has only average precisions, and then the first only AUCs.
    second = F.col("view") % 2 == 1
    metrics = (
        found.withColumn("slice", F.expr("view div 2"))
        .join(views.select("slice", (F.col("present") == "").alias("every")), "slice")
        .groupBy("slice")
        .agg(
            F.avg(F.when(~second, F.col("auc"))).alias(RANKING_METRICS[0]),
            F.avg(F.when(second | F.col("every"), F.col("ap"))).alias(RANKING_METRICS[1]),
        )
    )
    return slices.select(*keys, "slice").join(metrics, "slice", "left").drop("slice")


def _present_in_resamples(
    predictions: DataFrame, slices: DataFrame, keys: Sequence[str], draws: ranking.Draws
) -> DataFrame:
    """``slice, resample, present``: the classes of the groups that each resample drew."""
    held = predictions.groupBy(*keys, F.col("unit").alias("draw"), F.col("label").alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = held.join(slices.select(*keys, "slice", "groups"), list(keys))
    counted = resampling.resampled_counts(cells, draws.resamples, draws.seed, draws.own)
    return durable(
        counted.groupBy("slice", "resample").agg(F.sort_array(F.collect_set(F.col("cell").cast("int"))).alias("present"))
    )


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [name for name in wide.columns if name not in keys]
    doubles = wide.select(*keys, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return doubles.unpivot(list(keys), [f"`{n}`" for n in names], "metric", "value")


def score_folds(
    predictions: DataFrame,
    class_names: Sequence[str],
    keys: Sequence[str] = SPLIT,
    ranking: bool = True,
) -> DataFrame:
    """Every metric of every slice as ``(keys, metric, value)``."""
    keys, n_classes = list(keys), len(class_names)
    cells = class_counts(confusion_counts(predictions, keys), keys).withColumn("f1", _f1())
    total = F.sum("actual")
    slices = cells.groupBy(*keys).agg(
        _over(F.sum("correct"), total).alias("accuracy"),
        (F.sum("f1") / F.lit(float(n_classes))).alias("macro_f1"),
        _over(F.sum(F.col("f1") * F.col("actual")), total).alias("weighted_f1"),
        total.cast("double").alias("n_items"),
        F.map_from_entries(
            F.collect_list(F.struct("class_index", F.struct("correct", "predicted", "actual", "f1")))
        ).alias("__cells"),
    )
    # One slice is one row with a short array of metrics: a single pass over the rows.
    entries = [
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))
        for name in (*COUNT_METRICS, "n_items")
    ]
    for index, name in enumerate(class_names):
        cell = F.try_element_at("__cells", F.lit(index))
        measures = {
            "precision": _over(cell["correct"], cell["predicted"]),
            "recall": _over(cell["correct"], cell["actual"]),
            "f1": cell["f1"],
            "support": cell["actual"].cast("double"),
        }
        entries += [
            F.struct(
                F.lit(f"{measure}_{name}").alias("metric"),
                F.coalesce(value, F.lit(0.0)).alias("value"),
            )
            for measure, value in measures.items()
        ]
    result = slices.select(*keys, F.inline(F.array(*entries)))
    if ranking:
        ranked = long_metrics(ranking_metrics(predictions, keys, n_classes), keys)
        result = result.unionByName(ranked)
    return result


def summarise_folds(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, sample deviation, range and number of defined estimates of each metric."""
    return metrics.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("folds"),
    )


def comparison(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model with ``<metric>_mean`` and ``<metric>_std`` columns."""
    wide = summary.groupBy("model").pivot("metric", list(metrics)).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    return wide


def headline(summary: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """One metric per model with its spread."""
    return summary.filter(F.col("metric") == metric).select("model", "mean", "std")


def per_class_recall(summary: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Mean recall per class per model, named by class."""
    recall = summary.filter(F.col("metric").startswith("recall_")).withColumn(
        "class", F.expr("substring(metric, 8)")
    )
    return recall.groupBy("model").pivot("class", list(class_names)).agg(F.first("mean"))


def headline_text(summary: DataFrame) -> DataFrame:
    """One line per model: accuracy and macro-F1, each with its spread."""
    wide = comparison(summary, ["accuracy", "macro_f1"])

    def part(metric: str, name: str) -> Column:
        return F.when(
            F.col(f"{metric}_mean").isNotNull(),
            F.format_string(
                f"{name} %.3f +/- %s",
                f"{metric}_mean",
                F.coalesce(F.format_string("%.3f", f"{metric}_std"), F.lit("nan")),
            ),
        )

    line = F.concat(
        F.when(F.length("model") < 10, F.lpad("model", 10, " ")).otherwise(F.col("model")),
        F.lit(": "),
        F.concat_ws("  ", part("accuracy", "acc"), part("macro_f1", "macro-F1")),
    )
    return wide.select("model", line.alias("headline"))


def window_predictions(windows: DataFrame) -> DataFrame:
    """Window rows of the first repeat, with position, label and scores."""
    return windows.filter(F.col("repeat") == 0).select(
        "model", "repeat", "fold", "item_id", "group_id", "window_index", "label", "probs"
    )
