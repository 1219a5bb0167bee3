"""Features that never see the signal, and a model that only looks them up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import require_columns
from tidemark.operators.joins import lookup
from tidemark.operators.notes import condition_columns
from tidemark.operators.ordered import durable, with_position

METADATA = ("native_rate", "year", "duration", "bytes")
LOGBOOK_CATEGORICAL = ("site", "code")
LOGBOOK_NUMERIC = ("native_rate", "year", "duration", "bytes", "lat", "lon")


def coded_name(field: str) -> str:
    return field if field.endswith("_code") else f"{field}_code"


def code_categories(df: DataFrame, fields: Sequence[str], spread: str = "item_id") -> DataFrame:
    """Add ``<field>_code``: position of the value in sorted order, -1 where absent.

    A blank string is a category of its own. The distinct values are ranked over
    range partitions, then looked up by value.
    """
    for field in fields:
        values = df.filter(F.col(field).isNotNull()).groupBy(field).agg(
            F.count(F.lit(1)).alias("__n")
        )
        coded = with_position(values, [], [(field, True)], "__code")
        joined = lookup(df, coded, [field], "__n", spread=[spread])
        df = joined.withColumn(
            coded_name(field), F.coalesce("__code", F.lit(-1)).cast("int")
        ).drop("__code")
    return df


def _numbers(names: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in names]


def metadata_matrix(df: DataFrame) -> DataFrame:
    """Rate, year, duration and size as ``features``: the control."""
    require_columns(df, *METADATA)
    return df.withColumn("features", F.array(*[F.col(n).cast("double") for n in METADATA]))


def logbook_names(conditions: Sequence[str]) -> list[str]:
    return [*map(coded_name, LOGBOOK_CATEGORICAL), *LOGBOOK_NUMERIC, *conditions]


def logbook_matrix(df: DataFrame) -> DataFrame:
    """Everything written down about an item as ``features``; nulls become 0."""
    conditions = condition_columns(df)
    require_columns(df, *LOGBOOK_CATEGORICAL, *LOGBOOK_NUMERIC)
    coded = code_categories(df, LOGBOOK_CATEGORICAL)
    return coded.withColumn("features", F.array(*_numbers(logbook_names(conditions))))


def class_weights(
    train: DataFrame, n_classes: int, keys: Sequence[str] = ("repeat", "fold")
) -> DataFrame:
    """n / (K * count) per class in each slice; a class not present weighs 0."""
    keys = list(keys)
    counts = train.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("m")
    )
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    weight = F.col("n") / (F.lit(n_classes) * F.col("m")[F.col("label")])
    return per.withColumn("label", F.explode(classes)).select(
        *keys, "label", F.coalesce(weight, F.lit(0.0)).alias("weight")
    )


def class_weights_by_groups(items: DataFrame, parts: DataFrame, n_classes: int) -> DataFrame:
    """The class weights of every split's training items, from the groups' plans.

    ``parts`` has ``repeat, fold, group_id, part``. What trains is what there is less what a split
    holds out, so items are counted once for each group and never listed per split.
    """
    cells = items.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("c"))
    splits = parts.select("repeat", "fold").distinct()
    counts = _left_over(_held(cells, parts, "label"), cells, splits, "label")
    per = counts.groupBy("repeat", "fold").agg(
        F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("m")
    )
    label = F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))
    count = F.coalesce(F.col("m")[F.col("label")], F.lit(0))
    weight = F.when(count > 0, F.col("n") / (F.lit(n_classes) * count)).otherwise(F.lit(0.0))
    return per.withColumn("label", label).select("repeat", "fold", "label", weight.alias("weight"))


def _held(cells: DataFrame, parts: DataFrame, *by: str) -> DataFrame:
    """``(repeat, fold, by..., c)``: what each split holds out, summed from cells of groups."""
    held = parts.filter(F.col("part") != "train").groupBy("group_id").agg(
        F.collect_list(F.struct("repeat", "fold")).alias("__plan")
    )
    rows = cells.join(held, "group_id").select(*by, "c", F.inline("__plan"))
    return rows.groupBy("repeat", "fold", *by).agg(F.sum("c").alias("c"))


def _left_over(held: DataFrame, cells: DataFrame, splits: DataFrame, by: str) -> DataFrame:
    """Counts of a short column ``by`` in the training part of every split."""
    # A row for each split and label: repeats x folds x classes.
    whole = cells.groupBy(by).agg(F.sum("c").alias("__all")).agg(F.collect_list(F.struct(by, "__all")).alias("__w"))
    every = splits.join(F.broadcast(whole)).select("repeat", "fold", F.inline("__w"))
    left = every.join(held, ["repeat", "fold", by], "left")
    return left.select("repeat", "fold", by, (F.col("__all") - F.coalesce("c", F.lit(0))).alias("c")).filter("c > 0")


def lookup_model(items: DataFrame, parts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Predict each test item by the label its key had most often in training, in every split.

    ``parts`` has ``repeat, fold, group_id, part``. An unseen key gets the majority label; ties go to
    the lowest label. Items are counted once as cells of (group, key, label); a split's tallies
    are the cells of the groups it holds out, taken from those of the whole table. Items are listed
    once for each repeat, in the result, and never for each split.
    """
    key = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields])
    rows, split = items.withColumn("__key", key), ["repeat", "fold"]
    cells = durable(rows.groupBy("group_id", "__key", "label").agg(F.count(F.lit(1)).alias("c")))
    tests = parts.filter(F.col("part") == "test").groupBy("group_id").agg(
        F.collect_list(F.struct(*split)).alias("__tests")
    )
    wanted = cells.join(tests, "group_id").select("__key", "c", F.inline("__tests"))
    wanted = wanted.groupBy(*split, "__key").agg(F.sum("c").alias("__n"))

    def tally(df: DataFrame, name: str, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias(name))

    whole = tally(cells.groupBy("__key", "label").agg(F.sum("c").alias("c")), "__all", "__key")
    held = tally(_held(cells, parts, "__key", "label"), "__held", *split, "__key")
    left = F.transform(
        F.map_entries("__all"),
        lambda e: F.struct((e["value"] - F.coalesce(F.col("__held")[e["key"]], F.lit(0))).alias("c"), (-e["key"]).alias("l")),
    )
    guess = -F.array_max(F.filter(left, lambda x: x["c"] > 0))["l"]
    labels = cells.groupBy("group_id", "label").agg(F.sum("c").alias("c"))
    majority = _left_over(_held(labels, parts, "label"), labels, parts.select(*split).distinct(), "label")
    majority = majority.groupBy(*split).agg(F.max_by("label", F.struct(F.col("c"), -F.col("label"))).alias("__majority"))
    guesses = (
        wanted.join(whole, "__key")
        .join(held, [*split, "__key"], "left")
        .withColumn("__guess", guess)
        .join(majority, split)
        .select(
            *split, "__key", "__n", F.coalesce("__guess", "__majority").alias("prediction"), F.col("__guess").isNotNull().alias("seen")
        )
    )
    sizes = cells.groupBy("group_id").agg(F.sum("c").alias("__n"))
    placed = lookup(rows, tests.join(sizes, "group_id"), ["group_id"], "__n", spread=["item_id"], how="inner")
    tested = placed.select(*rows.columns, F.inline("__tests"))
    return lookup(tested, guesses, [*split, "__key"], "__n", spread=["item_id"]).drop("__key")
