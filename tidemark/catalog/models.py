"""Fitted models on the embeddings, and what is read off them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog.base import SEED, SEGMENTS, kept_items, predictions, query, rounded, sql, table
from tidemark.catalog.base import h as digest_sql
from tidemark.operators import controls, models
from tidemark.parameters import Split
from tidemark.plans.crossval import cross_validate, fold_pairs, folds_for, planned_windows

CLASSES = [str(k) for k in range(10)]
PARTS = Split(n_folds=5, seed=SEED)
# Forests are fitted fold by fold.
FEW = Split(n_folds=2, seed=SEED)


def vectors(spark, d, binary: bool = False):
    """Embeddings as one-window items; five neighbours form a group."""
    label = (F.col("label") >= 5).cast("int") if binary else F.col("label")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.floor(F.col("vec_id") / 5).alias("group_id"),
        label.cast("string").alias("class"),
        label.alias("label"),
        F.lit(0).alias("window_index"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


@query("M6_fit_trees")
def m6(spark, d):
    """Boosted trees on the control matrix: does the paperwork name one class?"""
    rows = controls.metadata_matrix(kept_items(spark, d)).select(
        "item_id",
        "group_id",
        "class",
        (F.col("label") == 0).cast("int").alias("label"),
        F.lit(0).alias("window_index"),
        "features",
    )
    done = cross_validate(
        rows, ["rest", SEGMENTS[0]], models.fit_trees(rounds=10, depth=3, patience=5), PARTS, "trees",
        ranking=False,
    )
    return done["metrics"]


@query("M7_fit_probe")
def m7(spark, d):
    done = cross_validate(
        vectors(spark, d), CLASSES, models.fit_probe(), PARTS, "probe", ranking=False
    )
    return done["predictions"].select("repeat", "fold", "item_id", "label", "prediction")


@query("M8_cross_validate")
def m8(spark, d):
    done = cross_validate(
        vectors(spark, d), CLASSES, models.fit_probe(), PARTS, "probe"
    )
    return done["summary"]


@query("M9_feature_importance")
def m9(spark, d):
    rows = vectors(spark, d)
    fit = models.fit_forest(numTrees=10, maxDepth=4)
    fitted = models.fit_folds(rows, folds_for(rows, FEW), fit, 10, [(0, 0), (0, 1)])
    gains = models.feature_importance(spark, fitted, [f"f{i}" for i in range(64)])
    return models.importance_shares(gains)


@query("X2_top_features")
def x2(spark, d):
    rows = vectors(spark, d, binary=True)
    fit = models.fit_forest(numTrees=5, maxDepth=4)
    fitted = models.fit_folds(rows, folds_for(rows, FEW), fit, 2, [(0, 0), (0, 1)])
    return models.feature_importance(spark, fitted, [f"f{i}" for i in range(64)], top=10)


@query(
    "M10_band_edges",
    """SELECT p_partkey, low, high FROM (
         SELECT p_partkey, round_even(i * (p_size / 8.0::DOUBLE), 0)::INT AS low,
           CASE WHEN i = 7 THEN p_size ELSE round_even((i + 1) * (p_size / 8.0::DOUBLE), 0)::INT END AS high
         FROM part CROSS JOIN (SELECT range AS i FROM range(8))) WHERE high > low""",
)
def m10(spark, d):
    bands = models.band_edges(F.col("p_size"), 8)
    return table(spark, d, "part").select("p_partkey", F.inline(bands))


HERTZ = [100.0 + 10 * i for i in range(64)]


@query("M11_occlusion")
def m11(spark, d):
    """Which stretch of the embedding a probe relies on, in every fold."""
    _, planned = planned_windows(vectors(spark, d), PARTS)
    fitted = models.fit_folds(planned, None, models.fit_probe(), 10, fold_pairs(PARTS))
    return models.occlusion_by_sums(
        fitted.tested(planned), fitted.matrix, fitted.offset, 64, CLASSES, HERTZ,
        keys=["repeat", "fold"], split="__split",
    )


def fixed_weights() -> tuple[np.ndarray, np.ndarray]:
    """A linear model that is written down and not fitted."""
    at, k = np.arange(64)[:, None], np.arange(10)[None, :]
    return (((31 * at + 17 * k) % 13 - 6) / 4)[None], (np.arange(10) / 8)[None]


_DROPS = ", ".join(
    f"max({n}) FILTER (WHERE low = -1) OVER () - {n} AS {n}_drop"
    for n in ["accuracy", "macro_f1", *[f"recall_{k}" for k in range(10)]]
)
_RECALLS = ", ".join(
    f"coalesce(max(recall) FILTER (WHERE k = {k}), 0) AS recall_{k}" for k in range(10)
)


@query(
    "M11_occlusion_fixed",
    f"""
    WITH bands AS (
      SELECT -1 AS low, -1 AS high UNION ALL
      SELECT range * 8, range * 8 + 8 FROM range(8)
    ), cells AS (
      SELECT vec_id, label, range AS place, CAST(embedding[range + 1] AS DOUBLE) AS x
      FROM embeddings CROSS JOIN range(64)
    ), scores AS (
      SELECT vec_id, label, low, high, k, k / 8.0::DOUBLE
        + sum(CASE WHEN place >= low AND place < high THEN 0 ELSE x * (((31 * place + 17 * k) % 13 - 6) / 4.0::DOUBLE) END) AS score
      FROM cells CROSS JOIN bands CROSS JOIN (SELECT range AS k FROM range(10)) GROUP BY vec_id, label, low, high, k
    ), items AS (
      SELECT vec_id, label, low, high, arg_max(k, score) AS prediction FROM scores GROUP BY ALL
    ), classes AS (
      SELECT low, high, k, count(*) FILTER (WHERE label = k AND prediction = k) AS hit,
        count(*) FILTER (WHERE label = k) AS actual, count(*) FILTER (WHERE prediction = k) AS told
      FROM items CROSS JOIN (SELECT range AS k FROM range(10)) GROUP BY ALL
    ), wide AS (
      SELECT low, high, sum(hit) / sum(actual)::DOUBLE AS accuracy,
        sum(CASE WHEN actual + told > 0 THEN 2 * hit / (actual + told)::DOUBLE ELSE 0 END) / 10 AS macro_f1, {_RECALLS}
      FROM (SELECT *, CASE WHEN actual > 0 THEN hit / actual::DOUBLE ELSE 0 END AS recall FROM classes) GROUP BY ALL
    ), dropped AS (SELECT *, {_DROPS} FROM wide)
    SELECT low::INT AS band_low_bin, high::INT AS band_high_bin,
      {", ".join(f"floor({n} * 1e6 + 0.5) / 1e6 AS {n}" for n in ["accuracy", "accuracy_drop", "macro_f1", "macro_f1_drop", *[f"recall_{k}{x}" for k in range(10) for x in ("", "_drop")]])}
    FROM dropped WHERE low >= 0""",
)
def m11_fixed(spark, d):
    """The same of a model with given weights, over all items."""
    matrix, offset = fixed_weights()
    found = models.occlusion_by_sums(vectors(spark, d), matrix, offset, 64, CLASSES, HERTZ)
    found = found.drop("band_low_hz", "band_high_hz", "band_center_hz")
    return rounded(found, *[c for c in found.columns if not c.startswith("band_")])


@query(
    "M12_training_peaks",
    """SELECT user_id AS run, arg_min(event_id, (-value, event_id)) AS best_epoch,
         max(value) AS best_score FROM events GROUP BY user_id""",
)
def m12(spark, d):
    """Events as training histories: a user is a run, an event an epoch."""
    history = table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("score")
    )
    return models.training_peaks(history, ["run"])


@query(
    "M13_sample_correct",
    sql(
        f"""SELECT item_id, label, prediction, rank::INT AS rank FROM (
              SELECT item_id, label, prediction, row_number() OVER (PARTITION BY label
                ORDER BY prediction = label DESC, {digest_sql(str(SEED), 'item_id')}, item_id) AS rank
              FROM preds WHERE model = 'a' AND repeat = 0)
            WHERE rank <= 8 AND prediction = label""",
        "preds",
    ),
)
def m13(spark, d):
    rows = predictions(spark, d).filter("model = 'a' AND repeat = 0")
    chosen = models.sample_correct(rows, 8, SEED)
    return chosen.select("item_id", "label", "prediction", "rank")


