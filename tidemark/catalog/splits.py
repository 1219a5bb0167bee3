"""Folds over the kept items, checks on them, and models that only look up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    N_FOLDS,
    REPEATS,
    SEED,
    SEGMENTS,
    add_cte,
    h,
    items,
    kept_items,
    multi_items,
    query,
    rounded,
    sql,
)
from tidemark.operators import controls, splits
from tidemark.operators.items import check_items
from tidemark.operators.ordered import durable

PLAN = {"n_folds": N_FOLDS, "repeats": REPEATS, "seed": SEED}
VALIDATION = 5

add_cte(
    "fitting",
    ("group_folds",),
    f"""
    SELECT g.repeat, f.fold, g.group_id, g.label, g.n,
      row_number() OVER (PARTITION BY g.repeat, f.fold, g.label
                         ORDER BY g.n DESC, g.group_id) - 1 AS rnk
    FROM group_folds g CROSS JOIN (SELECT range::INT AS fold FROM range({N_FOLDS})) f
    WHERE g.fold <> f.fold""",
)
add_cte(
    "parts",
    ("fitting", "group_folds"),
    f"""
    SELECT repeat, fold, group_id, label, n, 'test' AS part FROM group_folds
    UNION ALL
    SELECT repeat, fold, group_id, label, n,
      CASE WHEN slot = 1 AND (size = {VALIDATION} OR (vblock = 0 AND size >= 2))
           THEN 'validation' ELSE 'train' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY repeat, fold, label, vblock
              ORDER BY {h(f"{SEED} + repeat + fold", "'validation'", "group_id")}, group_id) AS slot,
            count(*) OVER (PARTITION BY repeat, fold, label, vblock) AS size
          FROM (SELECT *, rnk // {VALIDATION} AS vblock FROM fitting))""",
)
add_cte(
    "item_parts",
    ("parts", "kept"),
    """SELECT k.*, repeat, fold, part FROM kept k JOIN parts p ON k.group_id = p.group_id""",
)
add_cte(
    "item_windows",
    ("kept",),
    """SELECT item_id, group_id, class, label, unnest(range(item_id % 4 + 1))::INT AS window_index
       FROM kept""",
)
add_cte(
    "summary",
    ("item_parts",),
    """SELECT repeat, fold, part, class, count(*) AS items, count(DISTINCT group_id) AS groups
       FROM item_parts GROUP BY ALL""",
)


def item_windows(spark, d):
    last = (F.col("item_id") % 4).cast("int")
    return kept_items(spark, d).select(
        "item_id",
        "group_id",
        "class",
        "label",
        F.explode(F.sequence(F.lit(0), last)).alias("window_index"),
    )


def parts(spark, d, **plan):
    return splits.group_parts(kept_items(spark, d), **{**PLAN, **plan})


def item_parts(spark, d, **plan):
    return splits.item_parts(kept_items(spark, d), **{**PLAN, **plan})


@query(
    "K1_items_from_windows",
    sql("SELECT item_id, group_id, class, label FROM kept", "kept"),
)
def k1(spark, d):
    return splits.items_from_windows(item_windows(spark, d))


@query(
    "K2_grouped_folds",
    sql(
        "SELECT group_id, label, n, block, place, repeat, fold FROM group_folds WHERE repeat = 0",
        "group_folds",
    ),
)
def k2(spark, d):
    kept = check_items(kept_items(spark, d))
    return splits.grouped_folds(kept, n_folds=N_FOLDS, seed=SEED)


_MULTI_RANK = f"""
    SELECT group_id, label, n, rnk // {N_FOLDS} AS block, rnk % {N_FOLDS} AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, group_id) - 1 AS rnk FROM (
        SELECT group_id, arg_min(label, (-c, label)) AS label, sum(c)::BIGINT AS n
        FROM (SELECT group_id, label, count(*) AS c FROM multi GROUP BY ALL) GROUP BY group_id))"""


@query(
    "K2_majority_label_folds",
    sql(
        f"""SELECT *, 0 AS repeat, (row_number() OVER (PARTITION BY label, block
              ORDER BY {h(str(SEED), "group_id")}, group_id) - 1)::INT AS fold
            FROM ({_MULTI_RANK})""",
        "multi",
    ),
)
def k2_multi(spark, d):
    return splits.grouped_folds(multi_items(spark, d), n_folds=N_FOLDS, seed=SEED)


@query(
    "K3_validation_holdout",
    sql("SELECT repeat, fold, group_id, label, n, part FROM parts", "parts"),
)
def k3(spark, d):
    return parts(spark, d)


@query(
    "K4_repeated_folds",
    sql("SELECT item_id, group_id, class, label, repeat, fold FROM item_folds", "item_folds"),
)
def k4(spark, d):
    tested = splits.item_test_folds(kept_items(spark, d), **PLAN)
    return tested.select("item_id", "group_id", "class", "label", "repeat", "fold")


@query("K5_fold_summary", sql("SELECT * FROM summary", "summary"))
def k5(spark, d):
    return splits.fold_summary(kept_items(spark, d), parts(spark, d))


@query(
    "K6_test_groups_pivot",
    sql(
        "SELECT repeat, fold, "
        + ", ".join(
            f"sum(groups) FILTER (WHERE class = '{c}')::BIGINT AS \"{c}\"" for c in SEGMENTS
        )
        + " FROM summary WHERE part = 'test' GROUP BY repeat, fold",
        "summary",
    ),
)
def k6(spark, d):
    return splits.test_groups_matrix(
        splits.fold_summary(kept_items(spark, d), parts(spark, d)), SEGMENTS
    )


@query(
    "K7_fold_coverage",
    sql(
        f"""SELECT s.repeat, s.class, k.groups, s.test_groups, s.test_folds,
              (k.groups = s.test_groups AND s.test_folds = {N_FOLDS} AND k.groups >= 10) AS covered
            FROM (SELECT repeat, class, sum(groups)::BIGINT AS test_groups, count(*) AS test_folds
                  FROM summary WHERE part = 'test' GROUP BY ALL) s
            JOIN (SELECT class, count(DISTINCT group_id) AS groups FROM kept GROUP BY class) k
              ON s.class = k.class""",
        "summary",
    ),
)
def k7(spark, d):
    kept = kept_items(spark, d)
    return splits.fold_coverage(splits.fold_summary(kept, parts(spark, d)), kept, N_FOLDS)


@query(
    "J3_rows_for_items",
    sql(
        """SELECT w.item_id, w.group_id, w.class, w.label, window_index, repeat, fold, part
           FROM item_windows w JOIN item_parts p ON w.item_id = p.item_id WHERE repeat = 0""",
        "item_windows",
        "item_parts",
    ),
)
def j3(spark, d):
    folds = splits.item_parts(kept_items(spark, d), n_folds=N_FOLDS, seed=SEED)
    return splits.rows_for_items(item_windows(spark, d), folds)


@query(
    "J8_fold_leak_check",
    sql(
        """SELECT repeat, fold, group_id, min(part) AS first_part, max(part) AS last_part
           FROM (SELECT repeat, fold, group_id,
                   CASE WHEN item_id % 50 = 0 THEN 'train' ELSE part END AS part FROM item_parts)
           GROUP BY ALL HAVING count(DISTINCT part) > 1""",
        "item_parts",
    ),
)
def j8(spark, d):
    """A split broken on purpose: one item in fifty is moved to the training part."""
    moved = F.when(F.col("item_id") % 50 == 0, "train").otherwise(F.col("part"))
    return splits.leaking_groups(item_parts(spark, d).withColumn("part", moved))


@query(
    "J8_uncovered_items",
    sql(
        f"""SELECT item_id, coalesce(times, 0) AS times, coalesce(splits, 0) AS splits
            FROM (SELECT k.item_id, count(p.item_id) AS times,
                    count(DISTINCT (repeat, fold)) FILTER (WHERE p.item_id IS NOT NULL) AS splits
                  FROM kept k LEFT JOIN (SELECT * FROM item_parts WHERE year <> 1995) p
                    ON k.item_id = p.item_id GROUP BY k.item_id)
            WHERE times <> {N_FOLDS * REPEATS}""",
        "item_parts",
    ),
)
def j8_cover(spark, d):
    """A split broken on purpose: one year never reaches the folds."""
    kept = kept_items(spark, d)
    thinned = item_parts(spark, d).filter(F.col("year") != 1995)
    return splits.uncovered_items(kept, thinned, N_FOLDS * REPEATS)


@query(
    "X3_fold_set_ops",
    sql(
        """SELECT repeat, fold, 'shared' AS side FROM (SELECT DISTINCT repeat, fold FROM group_folds)
           WHERE repeat = 0 UNION ALL
           SELECT repeat, fold, 'unpaired' FROM (SELECT DISTINCT repeat, fold FROM group_folds)
           WHERE repeat <> 0""",
        "group_folds",
    ),
)
def x3(spark, d):
    """Splits two models share, and those only the repeated one has."""
    many = splits.grouped_folds(kept_items(spark, d), **PLAN).select("repeat", "fold").distinct()
    once = splits.grouped_folds(kept_items(spark, d), n_folds=N_FOLDS, seed=SEED).select(
        "repeat", "fold"
    )
    shared = many.intersect(once).withColumn("side", F.lit("shared"))
    return shared.unionByName(many.subtract(once).withColumn("side", F.lit("unpaired")))


# ---------------------------------------------------------------- controls and lookup
_CODES = """(SELECT site AS v, dense_rank() OVER (ORDER BY site) - 1 AS k
             FROM (SELECT DISTINCT site FROM items))"""
_CODE_CODES = """(SELECT code AS v, dense_rank() OVER (ORDER BY code) - 1 AS k
             FROM (SELECT DISTINCT code FROM items))"""


@query(
    "M1_code_categories",
    sql(
        f"""SELECT item_id, site, a.k::INT AS site_code, lat,
              coalesce(b.k, -1)::INT AS lat_code
            FROM items LEFT JOIN {_CODES} a ON site = a.v
            LEFT JOIN (SELECT lat AS v, dense_rank() OVER (ORDER BY lat) - 1 AS k
              FROM (SELECT DISTINCT lat FROM items WHERE lat IS NOT NULL)) b ON lat = b.v""",
        "items",
    ),
)
def m1(spark, d):
    coded = controls.code_categories(items(spark, d), ["site", "lat"])
    return coded.select("item_id", "site", "site_code", "lat", "lat_code")


def _named(df, names):
    entries = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), "features")
    return df.select("item_id", F.inline(entries).alias("name", "value"))


def _features(pairs: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT item_id, '{name}' AS name, {value}::DOUBLE AS value FROM {source}"
        for name, value in pairs
    )


@query(
    "M2_metadata_matrix",
    sql(_features([(n, n) for n in controls.METADATA], "items"), "items"),
)
def m2(spark, d):
    return _named(controls.metadata_matrix(items(spark, d)), controls.METADATA)


@query(
    "M3_logbook_matrix",
    sql(
        _features(
            [("site_code", "sk"), ("code_code", "ck")]
            + [(n, f"coalesce({n}, 0)") for n in controls.LOGBOOK_NUMERIC]
            + [(n, f"{n}::INT") for n in ("cond_urgent", "cond_final")],
            f"""(SELECT i.*, a.k AS sk, b.k AS ck FROM items i JOIN {_CODES} a ON site = a.v
                 JOIN {_CODE_CODES} b ON code = b.v)""",
        ),
        "items",
    ),
)
def m3(spark, d):
    names = controls.logbook_names(["cond_urgent", "cond_final"])
    return _named(controls.logbook_matrix(items(spark, d)), names)


@query(
    "M4_class_weights",
    sql(
        """SELECT repeat, fold, label, floor((sum(n) OVER (PARTITION BY repeat, fold)
              / (5 * n)::DOUBLE) * 1e6 + 0.5) / 1e6 AS weight
           FROM (SELECT repeat, fold, label, count(*) AS n FROM item_parts
                 WHERE part = 'train' GROUP BY ALL)""",
        "item_parts",
    ),
)
def m4(spark, d):
    kept = durable(kept_items(spark, d).select("item_id", "group_id", "label"))
    parts = durable(splits.group_parts(kept, n_folds=N_FOLDS, repeats=REPEATS, seed=SEED))
    return rounded(controls.class_weights_by_groups(kept, parts, len(SEGMENTS)), "weight")


add_cte(
    "looked_up",
    ("item_parts",),
    """
    SELECT t.item_id, t.group_id, t.class, t.label, t.repeat, t.fold,
      coalesce(g.label, m.label) AS prediction, g.label IS NOT NULL AS seen
    FROM (SELECT * FROM item_parts WHERE part = 'test') t
    LEFT JOIN (SELECT repeat, fold, code, site, arg_min(label, (-n, label)) AS label
      FROM (SELECT repeat, fold, code, site, label, count(*) AS n FROM item_parts
            WHERE part = 'train' GROUP BY ALL) GROUP BY ALL) g
      ON t.repeat = g.repeat AND t.fold = g.fold AND t.code = g.code AND t.site = g.site
    JOIN (SELECT repeat, fold, arg_min(label, (-n, label)) AS label
      FROM (SELECT repeat, fold, label, count(*) AS n FROM item_parts
            WHERE part = 'train' GROUP BY ALL) GROUP BY ALL) m
      ON t.repeat = m.repeat AND t.fold = m.fold""",
)


@query(
    "M5_lookup_model",
    sql("SELECT item_id, repeat, fold, label, prediction, seen FROM looked_up", "looked_up"),
)
def m5(spark, d):
    kept = durable(kept_items(spark, d).select("item_id", "group_id", "label", "code", "site"))
    parts = durable(splits.group_parts(kept, n_folds=N_FOLDS, repeats=REPEATS, seed=SEED))
    predicted = controls.lookup_model(kept, parts, ["code", "site"])
    return predicted.select("item_id", "repeat", "fold", "label", "prediction", "seen")
