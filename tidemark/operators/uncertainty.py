"""What a margin settles: paired tests, group bootstrap, false discovery rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ComparisonError, require_columns
from tidemark.functions.student import t_quantile, t_tail
from tidemark.operators.joins import lookup
from tidemark.operators.ordered import PART, Ordered, durable
from tidemark.operators.ranking import Draws
from tidemark.operators.resampling import resampled_counts
from tidemark.operators.scoring import (
    COUNT_METRICS,
    confusion_counts,
    count_metrics,
    ranking_metrics,
)

RESAMPLES = 2000
CONFIDENCE = 0.95


# ------------------------------------------------------------------- paired comparison
def fold_scores(metrics: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """One score per (model, repeat, fold); a frame without repeats is repeat 0."""
    require_columns(metrics, "fold", "metric", "value", error=ComparisonError)
    if metrics.filter(F.col("metric") == metric).select("metric").isEmpty():
        raise ComparisonError(f"no split has a score for {metric!r}")
    if "repeat" not in metrics.columns:
        metrics = metrics.withColumn("repeat", F.lit(0))
    keys = [name for name in ("model", "repeat", "fold") if name in metrics.columns]
    return metrics.filter(F.col("metric") == metric).select(*keys, F.col("value").alias("score"))


def shared_folds(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pair each model with its control on the splits both were scored on.

    ``pairs`` has ``model`` and ``control`` (and any columns to carry along). The job fails
    on a pair without a shared split.
    """
    left = scores.select("model", "repeat", "fold", F.col("score").alias("left"))
    right = scores.select(
        F.col("model").alias("control"), "repeat", "fold", F.col("score").alias("right")
    )
    splits = left.join(right, ["repeat", "fold"])
    both = pairs.join(splits, ["model", "control"], "left")
    fail = F.raise_error(
        F.concat(F.lit("no split scored both "), F.col("model"), F.lit(" and "), F.col("control"))
    )
    return both.withColumn("fold", F.when(F.col("fold").isNull(), fail.cast("int")).otherwise(F.col("fold")))


def matched_folds(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pair two score frames that must cover the same folds; the job fails if they do not."""
    keys = [name for name in ("repeat", "fold") if name in left.columns]
    both = left.select(*keys, F.col("score").alias("left")).join(
        right.select(*keys, F.col("score").alias("right")), keys, "full"
    )
    missing = F.col("left").isNull() | F.col("right").isNull()
    fail = F.raise_error(F.lit("paired comparison needs the same folds on both sides"))
    return both.withColumn(
        "left", F.when(missing, fail.cast("double")).otherwise(F.col("left"))
    )


def _spread(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of the differences; a split whose score is undefined on a side is no split."""
    d = F.col("left") - F.col("right")
    sign = F.when(d > 0, 1).when(d < 0, -1).otherwise(0)
    grouped = paired.withColumn("__d", d).withColumn("__s", sign).groupBy(*by).agg(
        F.avg(F.when(F.col("__d").isNotNull(), F.col("left"))).alias("mean"),
        F.avg(F.when(F.col("__d").isNotNull(), F.col("right"))).alias("control_mean"),
        F.avg("__d").alias("margin"),
        F.var_samp("__d").alias("variance"),
        (F.min("__d") == F.max("__d")).alias("constant"),
        F.min("__d").alias("__only"),
        F.count_if(F.col("__s") > 0).alias("__up"),
        F.count_if(F.col("__s") < 0).alias("__down"),
        F.count("__d").alias("folds"),
        F.countDistinct(F.when(F.col("__d").isNotNull(), F.col("fold"))).alias("folds_per_repeat"),
    )
    # With no spread the mean is the one difference, exactly.
    grouped = grouped.withColumn(
        "margin", F.when(F.col("constant"), F.col("__only")).otherwise(F.col("margin"))
    )
    margin = F.col("margin")
    agreeing = F.when(margin > 0, F.col("__up")).when(margin < 0, F.col("__down")).otherwise(0)
    few = (F.col("folds") < 2) | (F.col("folds_per_repeat") < 2)
    fail = F.raise_error(F.lit("a comparison needs at least two shared folds"))
    return grouped.withColumn("agreeing", agreeing.cast("bigint")).withColumn(
        "folds", F.when(few, fail.cast("bigint")).otherwise(F.col("folds"))
    ).drop("__only", "__up", "__down")


def _overlap() -> Column:
    return F.lit(1.0) / F.col("folds") + F.lit(1.0) / (F.col("folds_per_repeat") - 1)


def paired_difference(
    paired: DataFrame, by: Sequence[str], confidence: float = CONFIDENCE
) -> DataFrame:
    """Corrected resampled t test per comparison.

    ``paired`` has ``left``, ``right`` and ``fold`` per split. The variance of the
    mean carries the overlap of training sets, 1/n + 1/(k - 1). Without any spread
    there is no p value, or 1 if the difference is 0.
    """
    table = _spread(paired, by)
    error = F.sqrt(_overlap() * F.col("variance"))
    degrees = (F.col("folds") - 1).cast("double")
    tested = ~F.col("constant")
    table = table.withColumn("__error", F.when(tested, error)).withColumn("__df", degrees)
    half = t_quantile(F.lit(0.5 + confidence / 2), F.col("__df")) * F.col("__error")
    p = F.lit(2.0) * t_tail(F.abs(F.col("margin") / F.col("__error")), F.col("__df"))
    margin = F.col("margin")
    return table.withColumn("__half", F.coalesce(half, F.lit(0.0))).select(
        *by,
        "mean",
        "control_mean",
        "margin",
        (margin - F.col("__half")).alias("low"),
        (margin + F.col("__half")).alias("high"),
        F.when(tested, p).when(margin == 0, F.lit(1.0)).alias("p_value"),
        "agreeing",
        "folds",
    )


def naive_and_corrected(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ordinary paired t statistic beside the corrected one, and the inflation."""
    table = _spread(paired, by).withColumn("__df", (F.col("folds") - 1).cast("double"))
    plain = F.col("margin") / F.sqrt(F.col("variance") / F.col("folds"))
    fixed = F.col("margin") / F.sqrt(_overlap() * F.col("variance"))
    tested = ~F.col("constant")
    return table.withColumns(
        {"naive_t": F.when(tested, plain), "corrected_t": F.when(tested, fixed)}
    ).select(
        *by,
        "margin",
        "naive_t",
        "corrected_t",
        (F.lit(2.0) * t_tail(F.abs("naive_t"), F.col("__df"))).alias("naive_p"),
        (F.lit(2.0) * t_tail(F.abs("corrected_t"), F.col("__df"))).alias("corrected_p"),
        (_overlap() * F.col("folds")).alias("variance_inflation"),
        "folds",
    )


def resolved(df: DataFrame) -> Column:
    return F.coalesce(F.col("p_value") < 0.05, F.lit(False))


def describe_margin(df: DataFrame) -> DataFrame:
    """``resolved``, and a line of facts: margin, interval, p, splits that agree, verdict."""
    margin = F.format_string("margin %+.3f", "margin")
    agree = F.format_string("%d/%d splits agree", "agreeing", "folds")
    flat = F.concat_ws("; ", margin, F.lit("equal on all splits, untested"), agree)
    tested = F.format_string("interval %+.3f to %+.3f; p %.3f", "low", "high", "p_value")
    ending = F.when(resolved(df), "resolved").otherwise("unresolved")
    return df.withColumn("resolved", resolved(df)).withColumn(
        "verdict",
        F.when(F.col("p_value").isNull(), flat).otherwise(
            F.concat_ws("; ", margin, tested, agree, ending)
        ),
    )


# --------------------------------------------------------------------------- bootstrap
def group_index(predictions: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Dense group numbers per slice: ``(keys, group, draw, groups)``."""
    laid = Ordered(predictions.select(*keys, group).distinct(), keys, [(group, True)])
    one = ("sum", F.lit(1).cast("bigint"))
    placed = laid.running(laid.frame, {"__rank": one})
    placed = laid.running(placed, {"__from": one}, reverse=True)
    groups = F.col("__rank") + F.col("__from") - 1
    fail = F.raise_error(F.lit("a bootstrap over groups needs two or more of them"))
    return placed.select(
        *keys,
        group,
        (F.col("__rank") - 1).alias("draw"),
        F.when(groups < 2, fail.cast("bigint")).otherwise(groups).alias("groups"),
    )


def _interval(estimates: DataFrame, keys: Sequence[str], metric: str, confidence: float):
    tail = (1 - confidence) / 2
    return estimates.groupBy(*keys).agg(
        F.percentile(metric, tail).alias("low"), F.percentile(metric, 1 - tail).alias("high")
    )


def cluster_bootstrap(
    predictions: DataFrame,
    n_classes: int | str,
    *,
    metric: str = "macro_f1",
    keys: Sequence[str] = ("model",),
    group: str = "group_id",
    resamples: int = RESAMPLES,
    confidence: float = CONFIDENCE,
    seed: int = 0,
    shared: bool = False,
) -> DataFrame:
    """Percentile interval of a metric when whole groups are drawn with replacement.

    Confusion counts add up over groups, so each group is reduced to its few counts once
    and the tasks that hold them make the draws (``resampling``): only the sums of a resample
    are shuffled. Ranking metrics do not add up; their rows are sorted once for all
    resamples (``ranking``). Slices with as many groups share their draws.

    Resamples share no draws with each other. ``shared`` lets those of more than ``resampling.STRIDE`` groups do
    so, which takes less work and gives an interval that rests on fewer independent resamples.

    ``n_classes`` is a number, or for count metrics the name of a column that tells it for each slice.
    """
    require_columns(predictions, group, "label", "prediction", *keys, error=ComparisonError)
    keys = list(keys)
    numbered = group_index(predictions, keys, group)
    if metric in COUNT_METRICS:
        carry = [n_classes] if isinstance(n_classes, str) else []
        cells = confusion_counts(predictions, [*keys, *carry, group]).join(numbered, [*keys, group])
        cells = durable(cells)
        # Slices are few: in one partition their numbers follow each other.
        slices = cells.select(*keys, *carry).distinct().coalesce(1)
        slices = durable(slices.withColumn("slice", F.monotonically_increasing_id()))
        # A label is a small number, so a pair of them is one code.
        coded = F.shiftleft(F.col("label").cast("bigint"), 32) + F.col("prediction")
        summed = resampled_counts(cells.join(slices, [*keys, *carry]).withColumn("cell", coded), resamples, seed, not shared)
        counts = summed.select(
            "slice",
            "resample",
            F.shiftright("cell", 32).cast("int").alias("label"),
            F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("prediction"),
            "n",
        )
        counts = counts.join(slices, "slice").drop("slice")
        estimates = count_metrics(counts, [*keys, "resample"], n_classes)
        totals = cells.groupBy(*keys, *carry, "label", "prediction").agg(F.sum("n").alias("n"))
        observed = count_metrics(totals, keys, n_classes)
    else:
        require_columns(predictions, "probs", error=ComparisonError)
        sizes = predictions.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__rows"))
        named = numbered.join(sizes, [*keys, group]).withColumnRenamed("draw", "unit")
        rows = lookup(predictions, named, [*keys, group], "__rows", spread=["item_id"], how="inner")
        rows = durable(rows.select(*keys, "item_id", "label", "probs", "unit", "groups"))
        estimates = ranking_metrics(rows, keys, n_classes, draws=Draws(resamples, seed, not shared), metric=metric)
        observed = ranking_metrics(rows, keys, n_classes, metric=metric)
    groups = numbered.groupBy(*keys).agg(F.max("groups").alias("groups"))
    return (
        observed.select(*keys, F.col(metric).alias("estimate"))
        .join(_interval(estimates, keys, metric, confidence), keys)
        .join(groups, keys)
    )


def interval_facts(df: DataFrame) -> DataFrame:
    """Width of an interval and whether it leaves zero out."""
    return df.withColumn("width", F.col("high") - F.col("low")).withColumn(
        "excludes_zero", (F.col("low") > 0) | (F.col("high") < 0)
    )


def bootstrap_unit_contrast(predictions: DataFrame, n_classes: int, **settings) -> DataFrame:
    """The interval over groups beside the one that takes every item as independent."""
    keys = list(settings.get("keys", ("model",)))
    by_group = interval_facts(cluster_bootstrap(predictions, n_classes, **settings))
    alone = cluster_bootstrap(predictions, n_classes, **{**settings, "group": "item_id"})
    by_item = interval_facts(alone)
    return by_group.select(
        *keys, "estimate", "groups", F.col("width").alias("group_width")
    ).join(
        by_item.select(*keys, F.col("groups").alias("items"), F.col("width").alias("item_width")),
        keys,
    ).withColumn("ratio", F.col("group_width") / F.col("item_width"))


# ----------------------------------------------------------------- false discovery rate
def benjamini_hochberg(df: DataFrame, p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Step-up adjusted p values over all rows at once; a null p stays null and uncounted.

    Equal p values share one row, ranks are a running count over range partitions,
    and the step-up minimum is a running minimum from the other end.
    """
    tested = df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("__n"))
    laid = Ordered(tested, [], [(p, True)])
    n = F.col("__n")
    ranked = laid.running(laid.frame, {"__rank": ("sum", n)})
    ranked = laid.running(ranked, {"__from": ("sum", n)}, reverse=True)
    comparisons = F.col("__rank") + F.col("__from") - n
    scaled = F.col(p) * comparisons / F.col("__rank")
    stepped = laid.running(
        ranked.withColumn("__scaled", scaled), {q: ("min", F.col("__scaled"))}, reverse=True
    )
    table = stepped.select(p, "__n", F.least(F.col(q), F.lit(1.0)).alias(q)).drop(PART)
    return lookup(df, table, [p], "__n")


def adjust(margins: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The same comparisons with q values and the verdict they allow."""
    return benjamini_hochberg(margins).withColumn("rejected", F.col("q_value") < threshold)


def survivors(adjusted: DataFrame, by: Sequence[str] = (), threshold: float = 0.05) -> DataFrame:
    """Comparisons, survivors, and the bar a plain division of the threshold sets."""
    return adjusted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.count_if(F.col("rejected")).alias("survivors"),
        (F.lit(threshold) / F.count(F.lit(1))).alias("divided_threshold"),
    )
