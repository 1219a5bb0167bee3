"""Scoring the predictions of five models over repeated folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    SEGMENTS,
    add_cte,
    predictions,
    query,
    rounded,
    sql,
    window_predictions,
)
from tidemark.operators import scoring
from tidemark.operators.ordered import durable
from tidemark.operators.scoring import SPLIT

K = len(SEGMENTS)
KEYS = list(SPLIT)
_KEYS = "model, repeat, fold"
_ARGMAX = "CASE " + " ".join(
    f"WHEN p{k} = greatest(p0, p1, p2, p3, p4) THEN {k}" for k in range(K)
) + " END"
_CLASSES = "(VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(SEGMENTS)) + ") c(k, class)"

add_cte(
    "rolled",
    ("wpreds",),
    f"SELECT *, {_ARGMAX} AS prediction FROM (SELECT {_KEYS}, item_id, min(group_id) AS group_id, "
    "min(class) AS class, min(label) AS label, "
    + ", ".join(f"avg(p{k}) AS p{k}" for k in range(K))
    + f" FROM wpreds GROUP BY {_KEYS}, item_id)",
)


def metric_ctes(name: str, source: str) -> str:
    """CTEs that score ``source`` per (model, repeat, fold); registers ``<name>_*``."""
    add_cte(
        f"{name}_classes",
        (source,),
        f"""
    SELECT {_KEYS}, k, c.class, count(*) FILTER (WHERE label = k AND prediction = k) AS tp,
      count(*) FILTER (WHERE prediction = k) AS pred, count(*) FILTER (WHERE label = k) AS act
    FROM {source} CROSS JOIN {_CLASSES} GROUP BY {_KEYS}, k, c.class""",
    )
    add_cte(
        f"{name}_table",
        (f"{name}_classes",),
        f"""
    SELECT {_KEYS}, k, class, CASE WHEN pred > 0 THEN tp / pred::DOUBLE ELSE 0 END AS precision,
      CASE WHEN act > 0 THEN tp / act::DOUBLE ELSE 0 END AS recall,
      CASE WHEN pred + act > 0 THEN 2 * tp / (pred + act)::DOUBLE ELSE 0 END AS f1,
      act AS support, tp FROM {name}_classes""",
    )
    add_cte(
        f"{name}_counts",
        (f"{name}_table",),
        f"""
    SELECT {_KEYS}, sum(tp) / sum(support)::DOUBLE AS accuracy, sum(f1) / {K} AS macro_f1,
      sum(f1 * support) / sum(support)::DOUBLE AS weighted_f1, sum(support)::BIGINT AS n_items
    FROM {name}_table GROUP BY {_KEYS}""",
    )
    add_cte(
        f"{name}_scores",
        (source,),
        f"""
    SELECT {_KEYS}, k, score, sum(pos)::BIGINT AS pos, sum(1 - pos)::BIGINT AS neg FROM ("""
        + " UNION ALL ".join(
            f"SELECT {_KEYS}, {k} AS k, p{k} AS score, (label = {k})::INT AS pos FROM {source}"
            for k in range(K)
        )
        + f") GROUP BY {_KEYS}, k, score",
    )
    add_cte(
        f"{name}_ranks",
        (f"{name}_scores",),
        f"""
    SELECT {_KEYS}, avg(auc) AS roc_auc_ovr_macro, avg(ap) AS average_precision_macro FROM (
      SELECT {_KEYS}, k,
        sum(neg * (above_pos - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc,
        sum(pos * above_pos / (above_pos + above_neg)::DOUBLE) / sum(pos) AS ap
      FROM (SELECT *, sum(pos) OVER w AS above_pos, sum(neg) OVER w AS above_neg
            FROM {name}_scores
            WINDOW w AS (PARTITION BY {_KEYS}, k ORDER BY score DESC))
      GROUP BY {_KEYS}, k) GROUP BY {_KEYS}""",
    )
    pieces = [
        f"SELECT {_KEYS}, '{m}' AS metric, {m}::DOUBLE AS value FROM {name}_counts"
        for m in ("accuracy", "macro_f1", "weighted_f1", "n_items")
    ]
    pieces += [
        f"SELECT {_KEYS}, '{m}_' || class AS metric, {m}::DOUBLE AS value FROM {name}_table"
        for m in ("precision", "recall", "f1", "support")
    ]
    count_only = " UNION ALL ".join(pieces)
    add_cte(f"{name}_plain", (f"{name}_counts", f"{name}_table"), count_only)
    ranked = [
        f"SELECT {_KEYS}, '{m}' AS metric, {m} AS value FROM {name}_ranks"
        for m in scoring.RANKING_METRICS
    ]
    add_cte(
        f"{name}_metrics",
        (f"{name}_plain", f"{name}_ranks"),
        f"SELECT * FROM {name}_plain UNION ALL " + " UNION ALL ".join(ranked),
    )
    return f"{name}_metrics"


metric_ctes("clip", "preds")
add_cte("wlabelled", ("wpreds",), f"SELECT *, {_ARGMAX} AS prediction FROM wpreds")
metric_ctes("window", "wlabelled")
add_cte(
    "clip_summary",
    ("clip_plain",),
    """SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
         max(value) AS max, count(value) AS folds FROM clip_plain GROUP BY model, metric""",
)


def plain_metrics(spark, d):
    """Count metrics of every model on every split, stored: a few rows per split."""
    return durable(scoring.score_folds(predictions(spark, d), SEGMENTS, ranking=False))


def summary(spark, d):
    return scoring.summarise_folds(plain_metrics(spark, d))


def item_counts(spark, d):
    return scoring.confusion_counts(predictions(spark, d), KEYS)


@query(
    "P11_predicted_class",
    sql("SELECT model, repeat, item_id, prediction FROM preds", "preds"),
)
def p11(spark, d):
    return predictions(spark, d).select("model", "repeat", "item_id", "prediction")


_P = ", ".join(f"p{k}" for k in range(K))


@query(
    "G1_roll_up_windows",
    sql(f"SELECT {_KEYS}, item_id, group_id, class, label, prediction, {_P} FROM rolled", "rolled"),
)
def g1(spark, d):
    rolled = scoring.roll_up_windows(window_predictions(spark, d), K)
    return scoring.widen_probs(rolled, K)


@query(
    "G2_confusion",
    sql(
        f"""SELECT m.model, a.class AS actual, p.class AS predicted, count(item_id) AS n
            FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN {_CLASSES.replace('c(k', 'a(k')}
            CROSS JOIN {_CLASSES.replace('c(k', 'p(k')}
            LEFT JOIN preds x ON x.model = m.model AND x.label = a.k AND x.prediction = p.k
            GROUP BY ALL""",
        "preds",
    ),
)
def g2(spark, d):
    return scoring.confusion(item_counts(spark, d), SEGMENTS)


@query(
    "G3_count_metrics",
    sql(
        f"""SELECT {_KEYS}, floor((accuracy) * 1e6 + 0.5) / 1e6 AS accuracy, floor((macro_f1) * 1e6 + 0.5) / 1e6 AS macro_f1,
              floor((weighted_f1) * 1e6 + 0.5) / 1e6 AS weighted_f1, n_items FROM clip_counts""",
        "clip_counts",
    ),
)
def g3(spark, d):
    scored = scoring.count_metrics(item_counts(spark, d), KEYS, K)
    return rounded(scored, *scoring.COUNT_METRICS)


@query(
    "G4_per_class",
    sql(
        f"""SELECT {_KEYS}, class, floor((precision) * 1e6 + 0.5) / 1e6 AS precision, floor((recall) * 1e6 + 0.5) / 1e6 AS recall,
              floor((f1) * 1e6 + 0.5) / 1e6 AS f1, support FROM clip_table""",
        "clip_table",
    ),
)
def g4(spark, d):
    table = scoring.per_class(item_counts(spark, d), KEYS, SEGMENTS)
    return rounded(table, "precision", "recall", "f1")


SCORED = [*KEYS, "label", "prediction", "probs"]


def scored_rows(spark, d):
    """What scores are made of, stored: it is read more than once."""
    return durable(predictions(spark, d).select(*SCORED))


def _ranking(metric: str) -> str:
    return sql(f"SELECT {_KEYS}, floor(({metric}) * 1e6 + 0.5) / 1e6 AS {metric} FROM clip_ranks", "clip_ranks")


@query("G5_roc_auc", _ranking("roc_auc_ovr_macro"))
def g5(spark, d):
    ranked = scoring.ranking_metrics(scored_rows(spark, d), KEYS, K)
    return rounded(ranked.drop("average_precision_macro"), "roc_auc_ovr_macro")


@query("G6_average_precision", _ranking("average_precision_macro"))
def g6(spark, d):
    ranked = scoring.ranking_metrics(scored_rows(spark, d), KEYS, K)
    return rounded(ranked.drop("roc_auc_ovr_macro"), "average_precision_macro")


@query(
    "G7_score_folds",
    sql(f"SELECT {_KEYS}, metric, floor((value) * 1e6 + 0.5) / 1e6 AS value FROM clip_metrics", "clip_metrics"),
)
def g7(spark, d):
    return rounded(scoring.score_folds(scored_rows(spark, d), SEGMENTS), "value")


@query(
    "G7_score_windows",
    sql(f"SELECT {_KEYS}, metric, floor((value) * 1e6 + 0.5) / 1e6 AS value FROM window_metrics", "window_metrics"),
)
def g7_windows(spark, d):
    marked = window_predictions(spark, d).withColumn("prediction", scoring.predicted_class(F.col("probs")))
    return rounded(scoring.score_folds(durable(marked.select(*SCORED), "zstd"), SEGMENTS), "value")


@query(
    "G8_summarise_folds",
    sql(
        """SELECT model, metric, floor((mean) * 1e6 + 0.5) / 1e6 AS mean, floor((std) * 1e6 + 0.5) / 1e6 AS std, floor((min) * 1e6 + 0.5) / 1e6 AS min,
             floor((max) * 1e6 + 0.5) / 1e6 AS max, folds FROM clip_summary""",
        "clip_summary",
    ),
)
def g8(spark, d):
    return rounded(summary(spark, d), "mean", "std", "min", "max")


_WIDE = ["accuracy", "macro_f1", "weighted_f1"]


@query(
    "G9_comparison",
    sql(
        "SELECT model, "
        + ", ".join(
            f"floor((max({s}) FILTER (WHERE metric = '{m}')) * 1e6 + 0.5) / 1e6 AS {m}_{s}"
            for m in _WIDE
            for s in ("mean", "std")
        )
        + " FROM clip_summary GROUP BY model",
        "clip_summary",
    ),
)
def g9(spark, d):
    wide = scoring.comparison(summary(spark, d), _WIDE)
    return rounded(wide, *[c for c in wide.columns if c != "model"])


@query(
    "G10_headline",
    sql(
        """SELECT model, floor((mean) * 1e6 + 0.5) / 1e6 AS mean, floor((std) * 1e6 + 0.5) / 1e6 AS std FROM clip_summary
           WHERE metric = 'macro_f1'""",
        "clip_summary",
    ),
)
def g10(spark, d):
    return rounded(scoring.headline(summary(spark, d)), "mean", "std")


@query(
    "G11_per_class_recall",
    sql(
        "SELECT model, "
        + ", ".join(
            f"floor((max(mean) FILTER (WHERE metric = 'recall_{c}')) * 1e6 + 0.5) / 1e6 AS \"{c}\"" for c in SEGMENTS
        )
        + " FROM clip_summary GROUP BY model",
        "clip_summary",
    ),
)
def g11(spark, d):
    return rounded(scoring.per_class_recall(summary(spark, d), SEGMENTS), *SEGMENTS)


@query(
    "G12_window_predictions",
    sql(
        f"SELECT {_KEYS}, item_id, group_id, window_index, label, {_P} FROM wpreds WHERE repeat = 0",
        "wpreds",
    ),
)
def g12(spark, d):
    rows = scoring.window_predictions(window_predictions(spark, d))
    return scoring.widen_probs(rows, K)


@query(
    "P13_headline_text",
    sql(
        """SELECT model, repeat(' ', greatest(10 - length(model), 0)) || model || ': acc ' || printf('%.3f', a) || ' +/- '
             || printf('%.3f', b) || '  macro-F1 ' || printf('%.3f', c) || ' +/- '
             || printf('%.3f', e) AS headline
           FROM (SELECT model, max(mean) FILTER (WHERE metric = 'accuracy') AS a,
                   max(std) FILTER (WHERE metric = 'accuracy') AS b,
                   max(mean) FILTER (WHERE metric = 'macro_f1') AS c,
                   max(std) FILTER (WHERE metric = 'macro_f1') AS e
                 FROM clip_summary GROUP BY model)""",
        "clip_summary",
    ),
)
def p13(spark, d):
    return scoring.headline_text(summary(spark, d))

