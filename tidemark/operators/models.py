"""Fitting and reading models per fold with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SplitError, TidemarkError
from tidemark.functions.hashing import stable_hash
from tidemark.operators import boosting, probes
from tidemark.operators.controls import class_weights
from tidemark.operators.ordered import durable
from tidemark.operators.scoring import (
    confusion_counts,
    count_metrics,
    per_class,
    roll_up_windows,
)

Predict = Callable[[DataFrame], DataFrame]
# fit(train, validation, n_classes) -> predictor; train carries ``weight``. An object with
# ``fit_all(planned, n_classes, splits)`` serves all splits at once instead.
Fit = Callable[[DataFrame, DataFrame, int], Predict]


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("__vector", array_to_vector(F.col("features").cast("array<double>")))


def _with_probs(df: DataFrame, probs: Column) -> DataFrame:
    return df.withColumn("probs", probs).drop(
        "__vector", "__scaled", "rawPrediction", "probability", "prediction"
    )


class Probes:
    """Linear softmax on standardised features, fitted for all splits at once (``probes``).

    Centre and scale come from each split's training rows alone; a constant column scales to
    0. Of several penalties each split takes the best on its validation rows.
    """

    def __init__(self, penalties: Sequence[float], max_iter: int):
        self.penalties, self.max_iter = list(penalties), max_iter

    def fit_all(self, planned: DataFrame, n_classes: int, splits: Sequence[tuple[int, int]]) -> "FittedProbes":
        rows = with_parts(planned, splits)
        _refuse_empty(rows, splits)
        matrix, offset = probes.fit_probes(rows, len(splits), n_classes, self.penalties, self.max_iter)
        return FittedProbes(splits, matrix, offset)


class FittedSplits(dict):
    """``{(repeat, fold): predict}``, and all test parts scored in one scan.

    ``probs_of`` gives the class probabilities of features by the model of a split's number.
    """

    def __init__(self, splits: Sequence[tuple[int, int]], probs_of: Callable, n_classes: int):
        self.splits, self.probs_of, self.n_classes = list(splits), probs_of, n_classes
        for number, split in enumerate(self.splits):

            def predict(df: DataFrame, number: int = number) -> DataFrame:
                return probes.scored_rows(df, lambda x, _: probs_of(x, number), n_classes)

            self[split] = predict

    def tested(self, planned: DataFrame) -> DataFrame:
        """Each window once for each split that tests it, numbered by ``__split``."""
        rows = with_parts(planned, self.splits).drop(PLAN)
        numbered = rows.withColumn("__splits", F.transform(probes.PARTS, lambda part, i: F.when(part == probes.TEST, i)))
        wanted = F.filter("__splits", lambda i: i.isNotNull())
        stamps = F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(f).alias("fold")) for r, f in self.splits])
        stamp = stamps[F.col("__split")]
        rows = numbered.withColumn("__split", F.explode(wanted))
        return rows.drop(probes.PARTS, "__splits").withColumns({"repeat": stamp["repeat"], "fold": stamp["fold"]})

    def predict_all(self, planned: DataFrame) -> DataFrame:
        scored = probes.scored_rows(self.tested(planned), self.probs_of, self.n_classes, "__split")
        return scored.drop("__split")


class FittedProbes(FittedSplits):
    """The probes with their coefficients."""

    def __init__(self, splits: Sequence[tuple[int, int]], matrix: np.ndarray, offset: np.ndarray):
        self.matrix, self.offset = matrix, offset
        super().__init__(splits, lambda x, one: probes.softmax(x @ matrix[one] + offset[one]), offset.shape[1])


def fit_probe(penalties: Sequence[float] = (0.01, 0.1), max_iter: int = 50) -> Probes:
    """Linear softmax on standardised features; the penalty is picked on validation."""
    return Probes(penalties, max_iter)


def with_parts(planned: DataFrame, splits: Sequence[tuple[int, int]]) -> DataFrame:
    """The part of each window's item in every split, as one short array of numbers.

    Windows that were written with the parts of the same splits have them already.
    """
    told = {"splits": [f"{r}:{f}" for r, f in splits]}
    if probes.PARTS in planned.columns and planned.schema[probes.PARTS].metadata == told:
        return planned
    names = ("train", "validation", "test")
    numbers = F.create_map(*[F.lit(x) for pair in zip(names, (probes.TRAIN, probes.VALIDATION, probes.TEST)) for x in pair])
    part = [F.coalesce(numbers[F.col(PLAN)[_split_key(r, f)]], F.lit(0)).cast("tinyint") for r, f in splits]
    return planned.withColumn(probes.PARTS, F.array(*part)).withMetadata(probes.PARTS, told)


def _refuse_empty(rows: DataFrame, splits: Sequence[tuple[int, int]]) -> None:
    trained = [F.count_if(F.col(probes.PARTS)[i] == probes.TRAIN).alias(f"s{i}") for i in range(len(splits))]
    for (repeat, fold), count in zip(splits, rows.agg(*trained).head()):
        if not count:
            raise TidemarkError(f"repeat {repeat} fold {fold} has no training windows")


class Trees:
    """Boosted trees of all splits and classes at once (``boosting``), stopped on validation."""

    def __init__(self, settings: boosting.Settings):
        self.settings = settings

    def fit_all(self, planned: DataFrame, n_classes: int, splits: Sequence[tuple[int, int]]) -> "FittedTrees":
        rows = with_parts(planned, splits)
        _refuse_empty(rows, splits)
        return FittedTrees(splits, boosting.Booster(rows, len(splits), n_classes, self.settings).fit())


class FittedTrees(FittedSplits):
    """``{(repeat, fold): predict}``; each predictor knows its features' gains."""

    def __init__(self, splits: Sequence[tuple[int, int]], booster: boosting.Booster):
        self.booster = booster.predictor()
        light, n_classes = self.booster, booster.n_classes
        super().__init__(splits, light.probs, n_classes)
        for number, split in enumerate(self.splits):
            self[split].importances = [light.gains(number)]


def fit_trees(**settings) -> Trees:
    """Boosted trees with class weights; a split keeps as many as its validation rows ask for."""
    return Trees(boosting.Settings(**settings))


def fit_forest(**settings) -> Fit:
    """Random forest: many classes in one model, with weights."""
    settings = {"numTrees": 20, "maxDepth": 5, "seed": 1234, **settings}

    def fit(train: DataFrame, validation: DataFrame, n_classes: int) -> Predict:
        model = RandomForestClassifier(
            featuresCol="__vector", weightCol="weight", **settings
        ).fit(_vectors(train))

        def predict(df: DataFrame) -> DataFrame:
            return _with_probs(model.transform(_vectors(df)), vector_to_array("probability"))

        predict.importances = [model.featureImportances.toArray()]
        return predict

    return fit


PLAN = "__plan"


def _split_key(repeat, fold) -> Column:
    """``repeat`` and ``fold`` as one text; each is a number or a column."""
    repeat, fold = (v if isinstance(v, Column) else F.lit(v) for v in (repeat, fold))
    return F.concat_ws(":", repeat.cast("string"), fold.cast("string"))


def with_plan(windows: DataFrame, folds: DataFrame, splits: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Each window once, with a map from "repeat:fold" to the part its item has there.

    A plan has one short entry per split, so features are never copied for a fold. Windows
    whose item has no plan are counted by the write itself and fail it. With ``splits`` their parts
    are written too, so that the steps of a fit need not look them up again.
    """
    entry = F.struct(_split_key(F.col("repeat"), F.col("fold")).alias("split"), F.col("part"))
    plans = folds.groupBy("item_id").agg(F.map_from_entries(F.collect_set(entry)).alias(PLAN))
    seen = Observation()
    watched = windows.join(plans, "item_id", "left").observe(seen, F.count_if(F.col(PLAN).isNull()).alias("loose"))
    planned = durable(with_parts(watched, splits) if splits else watched)
    if seen.get["loose"]:
        raise SplitError(f"{seen.get['loose']} windows belong to items that the folds do not have")
    return planned


def in_part(planned: DataFrame, repeat: int, fold: int, part: str) -> DataFrame:
    """The windows of one part of one split, stamped with the split."""
    chosen = planned.filter(F.col(PLAN)[_split_key(repeat, fold)] == part)
    return chosen.drop(PLAN, probes.PARTS).withColumns({"repeat": F.lit(repeat), "fold": F.lit(fold)})


def fit_folds(
    windows: DataFrame, folds: DataFrame, fit: Fit, n_classes: int, splits: Sequence[tuple[int, int]]
) -> dict[tuple[int, int], Predict]:
    """Fit one model per (repeat, fold) on that fold's training windows.

    ``windows`` may carry its plan already. A fit that knows all splits at once is asked once.
    """
    planned = windows if PLAN in windows.columns else with_plan(windows, folds)
    if hasattr(fit, "fit_all"):
        return fit.fit_all(planned, n_classes, splits)
    # Only labels are listed per split, and at once counted.
    listed = planned.select("label", F.explode(PLAN).alias("split", "part")).filter("part = 'train'")
    weights = durable(class_weights(listed, n_classes, keys=["split"]))
    fitted = {}
    for repeat, fold in splits:
        own = weights.filter(F.col("split") == f"{repeat}:{fold}").select("label", "weight")
        train = in_part(planned, repeat, fold, "train").join(own, "label")
        validation = in_part(planned, repeat, fold, "validation")
        train = train.persist()
        try:
            if train.isEmpty():
                raise TidemarkError(f"repeat {repeat} fold {fold} has no training windows")
            fitted[repeat, fold] = fit(train, validation, n_classes)
        finally:
            train.unpersist()
    return fitted


def predict_folds(
    windows: DataFrame, folds: DataFrame, fitted: dict[tuple[int, int], Predict], model: str
) -> DataFrame:
    """Window scores of every fold's model on its own test items, stamped."""
    planned = windows if PLAN in windows.columns else with_plan(windows, folds)
    if hasattr(fitted, "predict_all"):
        return fitted.predict_all(planned).withColumn("model", F.lit(model))
    parts = [
        predict(in_part(planned, repeat, fold, "test"))
        for (repeat, fold), predict in fitted.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("model", F.lit(model))


def feature_importance(
    spark, fitted: dict[tuple[int, int], Predict], names: Sequence[str], top: int = 60
) -> DataFrame:
    """``(repeat, fold, feature, gain)``, the top features of each fold."""
    rows = [
        (repeat, fold, name, float(sum(values) / len(values)))
        for (repeat, fold), predict in fitted.items()
        for name, values in zip(names, zip(*predict.importances))
    ]
    table = spark.createDataFrame(rows, "repeat int, fold int, feature string, gain double")
    return top_features(table, top)


def top_features(gains: DataFrame, n: int, by: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    """The n features of largest gain in each slice; ties by name."""
    window = Window.partitionBy(*by).orderBy(F.desc("gain"), "feature")
    ranked = gains.withColumn("__rank", F.row_number().over(window))
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def importance_shares(gains: DataFrame, n: int | None = None) -> DataFrame:
    """Mean gain of each feature over folds and its share of the total."""
    means = gains.groupBy("feature").agg(F.avg("gain").alias("gain"))
    # One row per feature, so a single partition holds the width of the matrix.
    total = F.sum("gain").over(Window.partitionBy(F.lit(0)))
    shares = means.withColumn("share", F.when(total > 0, F.col("gain") / total))
    return shares if n is None else shares.orderBy(F.desc("gain"), "feature").limit(n)


def band_edges(n_bins: int | Column, groups: int) -> Column:
    """Contiguous near-equal bands ``(low, high)`` over the bins; empty ones dropped."""
    n = n_bins if isinstance(n_bins, Column) else F.lit(n_bins)
    cut = lambda i: F.when(i == groups, n).otherwise(F.rint(i * (n / groups))).cast("int")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda i: F.struct(cut(i).alias("low"), cut(i + 1).alias("high")),
    )
    return F.filter(bands, lambda b: b["high"] > b["low"])


def hide_bands(df: DataFrame, n_bins: int, groups: int) -> DataFrame:
    """Every row once per band with that band zeroed, and once untouched (band -1).

    A feature row is a matrix of ``n_bins`` rows, one behind another: a cell's bin is its
    place divided by the length of a row. A flat vector has rows of one cell.
    """
    frames = F.floor(F.size("features") / n_bins).cast("int")
    untouched = F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high")))
    rows = df.withColumn(
        "__band", F.explode(F.concat(untouched, band_edges(n_bins, groups)))
    ).withColumn("low", F.col("__band")["low"]).withColumn("high", F.col("__band")["high"])
    hidden = F.transform(
        "features",
        lambda v, i: F.when(
            (i >= F.col("low") * frames) & (i < F.col("high") * frames), 0.0
        ).otherwise(v),
    )
    return rows.withColumn("features", hidden).drop("__band")


def occlusion(
    tested: DataFrame,
    predict: Predict,
    n_bins: int,
    class_names: Sequence[str],
    frequencies: Sequence[float],
    groups: int = 8,
) -> DataFrame:
    """What the score loses when each band is hidden, for all bands in one job, by any model."""
    return _occluded(predict(hide_bands(tested, n_bins, groups)), [], class_names, frequencies)


def occlusion_by_sums(
    tested: DataFrame,
    matrix: np.ndarray,
    offset: np.ndarray,
    n_bins: int,
    class_names: Sequence[str],
    frequencies: Sequence[float],
    groups: int = 8,
    keys: Sequence[str] = (),
    split: str | None = None,
) -> DataFrame:
    """The same of a linear model, whose score without a band is its score less the band's share.

    ``matrix`` (models, features, classes) and ``offset`` have a model for each number in the column
    ``split``. Features are read once; only class scores leave the task, in a row for each band.
    """
    keys = list(keys)
    width, n_classes = matrix.shape[1], matrix.shape[2]
    cuts = [round(i * (n_bins / groups)) for i in range(groups)] + [n_bins]
    bands = [(-1, -1)] + [(low, high) for low, high in zip(cuts, cuts[1:]) if high > low]
    frames = width // n_bins

    def hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            probs = np.zeros((n, len(bands), n_classes))
            x = probes.batch_matrix(batch, "features") if n else np.zeros((0, width))
            own = batch.column(split).to_numpy() if split else np.zeros(n, dtype=int)
            for one in np.unique(own):
                mine = own == one
                whole = x[mine] @ matrix[one] + offset[one]
                for b, (low, high) in enumerate(bands):
                    part = slice(low * frames, high * frames) if high >= 0 else slice(0, 0)
                    probs[mine, b] = probes.softmax(whole - x[mine, part] @ matrix[one][part])
            kept = batch.drop_columns(["features"]).take(pa.array(np.repeat(np.arange(n), len(bands))))
            told = [pa.array(np.tile([band[i] for band in bands], n), pa.int32()) for i in (0, 1)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(n * len(bands) + 1, dtype=np.int32) * n_classes), pa.array(probs.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *told, lists], names=[*kept.schema.names, "low", "high", "probs"]
            )

    needed = list(dict.fromkeys([*keys, "item_id", "group_id", "class", "label", *([split] if split else [])]))
    slim = tested.select(*needed, "features")
    scored = slim.mapInArrow(
        hidden,
        T.StructType(
            [
                *slim.drop("features").schema.fields,
                T.StructField("low", T.IntegerType()),
                T.StructField("high", T.IntegerType()),
                T.StructField("probs", T.ArrayType(T.DoubleType())),
            ]
        ),
    )
    return _occluded(scored, keys, class_names, frequencies)


def _occluded(
    scored: DataFrame, slices: Sequence[str], class_names: Sequence[str], frequencies: Sequence[float]
) -> DataFrame:
    """Scores of every band and what they lose against the untouched rows (band -1)."""
    slices, n_classes = list(slices), len(class_names)
    keys = [*slices, "low", "high"]
    items = roll_up_windows(scored, n_classes, keys)
    counts = confusion_counts(items, keys)
    recalls = per_class(counts, keys, class_names).groupBy(*keys).pivot(
        "class", list(class_names)
    ).agg(F.first("recall"))
    recalls = recalls.select(*keys, *[F.col(n).alias(f"recall_{n}") for n in class_names])
    scores = count_metrics(counts, keys, n_classes).drop("n_items", "weighted_f1").join(recalls, keys)
    names = [c for c in scores.columns if c not in keys]
    # A slice is one row for each band, and one untouched.
    whole = Window.partitionBy(*(slices or [F.lit(0)]))
    for name in names:
        base = F.max(F.when(F.col("low") == -1, F.col(name))).over(whole)
        scores = scores.withColumn(f"{name}_drop", base - F.col(name))
    hz = F.array(*[F.lit(float(f)) for f in frequencies])
    low_hz, high_hz = hz[F.col("low")], hz[F.col("high") - 1]
    return scores.filter("low >= 0").select(
        *slices,
        F.col("low").alias("band_low_bin"),
        F.col("high").alias("band_high_bin"),
        low_hz.alias("band_low_hz"),
        high_hz.alias("band_high_hz"),
        F.sqrt(low_hz * high_hz).alias("band_center_hz"),
        *[c for n in names for c in (n, f"{n}_drop")],
    )


def training_peaks(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """Epoch of the best validation score; the earliest on ties."""
    return history.groupBy(*by).agg(
        F.max_by("epoch", F.struct(F.col("score"), -F.col("epoch"))).alias("best_epoch"),
        F.max("score").alias("best_score"),
    )


def sample_correct(predictions: DataFrame, n: int, seed: int, row_id: str = "item_id") -> DataFrame:
    """Up to n rows per class, correct ones only where a class has any; seeded.

    The row-number filter keeps n candidates per class in every partition before the
    shuffle, so a large class is never sorted whole.
    """
    correct = F.col("prediction") == F.col("label")
    order = Window.partitionBy("label").orderBy(
        F.desc("correct"), stable_hash(F.lit(seed), F.col(row_id)), row_id
    )
    ranked = predictions.withColumn("correct", correct).withColumn("rank", F.row_number().over(order))
    chosen = ranked.filter(F.col("rank") <= n)
    any_correct = F.max("correct").over(Window.partitionBy("label"))
    return chosen.withColumn("__any", any_correct).filter(F.col("correct") | ~F.col("__any")).drop("__any")
