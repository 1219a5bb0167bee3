"""Folds that never split a group: dealt by size, class stratified, repeated.

Groups are ranked by size inside their majority class and cut into blocks of K; a
digest of (seed + repeat, group) orders the members of a block, and the position in
the block is the fold. Sorting gives balance, the digest gives repeats that differ,
and only the ranking touches all groups, through a range-partitioned running count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import SplitError, require_columns
from tidemark.functions.hashing import stable_hash
from tidemark.operators.joins import lookup, spread_out
from tidemark.operators.ordered import Ordered, durable

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def items_from_windows(windows: DataFrame) -> DataFrame:
    """One row per item that produced at least one window."""
    return windows.select("item_id", "group_id", "class", "label").distinct()


def group_sizes(items: DataFrame) -> DataFrame:
    """``(group_id, label, n)``: items per group, and its majority label (lowest on ties)."""
    cells = items.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("c"))
    return cells.groupBy("group_id").agg(
        F.max_by("label", F.struct(F.col("c"), -F.col("label"))).alias("label"),
        F.sum("c").alias("n"),
    )


def ranked_groups(items: DataFrame, n_folds: int) -> DataFrame:
    """Groups with the block they belong to and their place in it."""
    require_columns(items, "item_id", "group_id", "label")
    laid = Ordered(group_sizes(items), ["label"], [("n", False), ("group_id", True)])
    if len(laid.frame.select("group_id").take(n_folds)) < n_folds:
        raise SplitError(f"fewer than {n_folds} groups cannot fill {n_folds} folds")
    ranked = laid.running(laid.frame, {"rank": ("sum", F.lit(1).cast("bigint"))})
    return ranked.select(
        "group_id",
        "label",
        "n",
        F.expr(f"(rank - 1) div {n_folds}").alias("block"),
        ((F.col("rank") - 1) % n_folds).alias("place"),
    )


def _dealt(order: Column, *block: str) -> Column:
    """Position of a row in its block; blocks hold as many rows as there are folds."""
    return F.row_number().over(Window.partitionBy(*block).orderBy(order, "group_id")) - 1


def grouped_folds(
    items: DataFrame, *, n_folds: int = 5, repeats: int = 1, seed: int = 1234
) -> DataFrame:
    """One row per group and repeat with the fold that tests it."""
    ranked = ranked_groups(items, n_folds).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    order = stable_hash(F.lit(seed) + F.col("repeat"), F.col("group_id"))
    return ranked.withColumn("fold", _dealt(order, "repeat", "label", "block").cast("int"))


def group_parts(
    items: DataFrame,
    *,
    n_folds: int = 5,
    repeats: int = 1,
    seed: int = 1234,
    validation_splits: int = 5,
) -> DataFrame:
    """``(repeat, fold, group_id, label, n, part)`` for every group in every fold.

    The fitting groups of a fold are dealt again to hold out a validation part. Their
    rank follows from the first ranking: a block loses at most its one test member,
    so no second ranking over all groups is needed.
    """
    own = grouped_folds(items, n_folds=n_folds, repeats=repeats, seed=seed)
    members = F.collect_list(F.struct("fold", "place")).over(
        Window.partitionBy("repeat", "label", "block")
    )
    wide = (
        own.withColumn("__members", members)
        .withColumnRenamed("fold", "__own")
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        .withColumn(
            "__tested",
            F.get(F.filter("__members", lambda m: m["fold"] == F.col("fold")), 0)["place"],
        )
        .drop("__members")
    )
    before = F.when(F.col("__tested") < F.col("place"), 1).otherwise(0)
    fit_rank = F.col("block") * (n_folds - 1) + F.col("place") - before
    test = F.col("__own") == F.col("fold")
    wide = wide.withColumn("__test", test).withColumn(
        "__vblock", F.when(test, F.lit(None)).otherwise(F.floor(fit_rank / validation_splits))
    )
    tested = wide.filter("__test").withColumn("part", F.lit(TEST))
    fitting = wide.filter(~F.col("__test"))
    block = ["repeat", "fold", "label", "__vblock"]
    order = stable_hash(
        F.lit(seed) + F.col("repeat") + F.col("fold"), F.lit(VALIDATION), F.col("group_id")
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*block))
    whole = (size == validation_splits) | ((F.col("__vblock") == 0) & (size >= 2))
    fitting = fitting.withColumn(
        "part", F.when((_dealt(order, *block) == 0) & whole, VALIDATION).otherwise(TRAIN)
    )
    columns = ["repeat", "fold", "group_id", "label", "n", "part"]
    return tested.select(columns).unionByName(fitting.select(columns))


def _onto_items(items: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Give every item the plan of its group; the plan is one short array per group."""
    # Dealt once for both joins of the lookup, and never broadcast: Spark takes the plans for as small as the
    # groups' files, but there is a row for each split in them.
    plans = durable(
        table.groupBy("group_id").agg(
            F.sort_array(F.collect_list(F.struct(*columns))).alias("__plan"), F.max("n").alias("n")
        )
    )
    kept = [name for name in items.columns if name not in columns]
    joined = lookup(
        items.select(kept), plans, ["group_id"], "n", spread=["item_id"], how="inner", shuffled=True
    )
    return joined.select(*kept, F.inline("__plan"))


def item_test_folds(items: DataFrame, **plan) -> DataFrame:
    """Items with the (repeat, fold) that tests them: one row per item and repeat."""
    return _onto_items(items, grouped_folds(items, **plan), "repeat", "fold")


def item_parts(items: DataFrame, **plan) -> DataFrame:
    """Items with their part in every (repeat, fold)."""
    return _onto_items(items, group_parts(items, **plan), "repeat", "fold", "part")


def rows_for_items(windows: DataFrame, folds: DataFrame) -> DataFrame:
    """Windows of the items in a fold part; items are the join key, not groups."""
    chosen = folds.select("item_id", "repeat", "fold", "part")
    # Folds repeat every item, so their planned size says little; do not broadcast them.
    return windows.join(chosen.hint("merge"), "item_id")


def leaking_groups(folds: DataFrame) -> DataFrame:
    """Groups that sit in two parts of one fold; must be empty."""
    # Least and greatest texts are found by sorting. So a group's few parts are sorted, not the rows of its
    # items; the count needs the parts apart, or Spark would take both steps as one.
    parts = folds.select("repeat", "fold", "group_id", "part").distinct()
    found = parts.groupBy("repeat", "fold", "group_id").agg(
        F.min("part").alias("first_part"), F.max("part").alias("last_part"), F.count("part").alias("__parts")
    )
    return found.filter(F.col("__parts") > 1).drop("__parts")


def uncovered_items(items: DataFrame, folds: DataFrame, n_splits: int) -> DataFrame:
    """Items that do not appear exactly once in each of the ``n_splits`` (repeat, fold)."""
    # Laid out by item once, over all tasks: both counts are made where the item's few rows are.
    laid = spread_out(folds.select("item_id", "repeat", "fold"), "item_id")
    each = laid.groupBy("item_id", "repeat", "fold").agg(F.count(F.lit(1)).alias("times"))
    # A split that lacks its number is no split.
    named = F.col("repeat").isNotNull() & F.col("fold").isNotNull()
    seen = each.groupBy("item_id").agg(F.sum("times").alias("times"), F.count_if(named).alias("splits"))
    return (
        items.select("item_id")
        .join(seen, "item_id", "full")
        .na.fill(0, ["times", "splits"])
        .filter((F.col("times") != n_splits) | (F.col("splits") != n_splits))
    )


def check_folds(items: DataFrame, folds: DataFrame, n_splits: int) -> DataFrame:
    """The folds, or an error that names some leaking groups or uncovered items."""
    leaks = [row["group_id"] for row in leaking_groups(folds).limit(5).collect()]
    if leaks:
        raise SplitError(f"groups on both sides of a fold: {leaks}")
    loose = [row["item_id"] for row in uncovered_items(items, folds, n_splits).limit(5).collect()]
    if loose:
        raise SplitError(f"folds do not partition the items: {loose}")
    return folds


def fold_summary(items: DataFrame, parts: DataFrame) -> DataFrame:
    """Items and groups per (repeat, fold, part, class).

    ``parts`` is the group table, so only (group, class) cells are joined, and they
    are the side that is hashed: the parts repeat every group in every fold.
    """
    cells = items.groupBy("group_id", "class").agg(F.count(F.lit(1)).alias("c"))
    return (
        parts.select("repeat", "fold", "group_id", "part")
        .join(cells.hint("shuffle_hash"), "group_id")
        .groupBy("repeat", "fold", "part", "class")
        .agg(F.sum("c").alias("items"), F.count(F.lit(1)).alias("groups"))
    )


def test_groups_matrix(summary: DataFrame, class_names) -> DataFrame:
    """Independent groups per class in each test fold."""
    held = summary.filter(F.col("part") == TEST)
    return held.groupBy("repeat", "fold").pivot("class", list(class_names)).agg(F.sum("groups"))


def fold_coverage(summary: DataFrame, items: DataFrame, n_folds: int, minimum: int = 10) -> DataFrame:
    """Per repeat and class: groups kept, groups tested, folds that test it, and a verdict."""
    held = summary.filter(F.col("part") == TEST).groupBy("repeat", "class").agg(
        F.sum("groups").alias("test_groups"), F.count(F.lit(1)).alias("test_folds")
    )
    kept = (
        items.select("class", "group_id")
        .distinct()
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("groups"))
    )
    fine = (
        (F.col("groups") == F.col("test_groups"))
        & (F.col("test_folds") == n_folds)
        & (F.col("groups") >= minimum)
    )
    return held.join(kept, "class").select(
        "repeat", "class", "groups", "test_groups", "test_folds", fine.alias("covered")
    )
