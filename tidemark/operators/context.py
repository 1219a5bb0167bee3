"""Which recorded field gives the label away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import require_columns
from tidemark.functions.notes import TAG_PREFIX, recorded
from tidemark.operators.joins import lookup
from tidemark.operators.notes import tag_columns

UNIQUE, SHARED, ABSENT = "unique", "shared", "absent"


def classes_per_value(items: DataFrame, field: str) -> DataFrame:
    """``(field, classes, items)`` for every recorded value.

    Two hash aggregates with map-side combine, so neither a hot value nor the
    distinct count needs more than its share of one task.
    """
    pairs = items.filter(recorded(items, field)).groupBy(field, "class").agg(
        F.count(F.lit(1)).alias("n")
    )
    return pairs.groupBy(field).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("items")
    )


def shared_values(items: DataFrame, field: str) -> DataFrame:
    """The recorded values that more than one class uses."""
    return classes_per_value(items, field).filter(F.col("classes") > 1).select(field)


def giveaway_labels(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(item_id, field, outcome)``: unique, shared or absent for each field.

    A field the items do not carry is left out.
    """
    fields = [field for field in fields if field in items.columns]
    require_columns(items, "item_id", "class", *fields)
    values = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.when(recorded(items, field), _as_text(items, field)).alias("value"),
            )
            for field in fields
        ]
    )
    # All fields are one column of values, so one aggregate and one join serve them all.
    rows = items.select("item_id", "class", F.inline(values))
    pairs = rows.filter("value is not null").groupBy("field", "value", "class").agg(F.count(F.lit(1)).alias("n"))
    facts = pairs.groupBy("field", "value").agg(
        (F.count(F.lit(1)) > 1).alias("__shared"), F.sum("n").alias("__items")
    )
    told = lookup(rows, facts, ["field", "value"], "__items", spread=["item_id"])
    outcome = F.when(F.col("value").isNull(), ABSENT).when(F.col("__shared"), SHARED).otherwise(UNIQUE)
    return told.select("item_id", "field", outcome.alias("outcome"))


def _as_text(items: DataFrame, field: str) -> Column:
    """A value as text, alike for values that are equal."""
    kind = dict(items.dtypes)[field]
    if kind == "binary":
        return F.hex(field)
    # Minus zero equals zero.
    return (F.col(field) + F.lit(0).cast(kind) if kind in ("float", "double") else F.col(field)).cast("string")


def field_giveaway(items: DataFrame, field: str, by: Sequence[str] = ()) -> DataFrame:
    """How much of the label one field hands over by itself.

    The share is taken over all items, recorded or not. Everything is answered from
    the per-value counts: no row is joined back.
    """
    by = list(by)
    pairs = items.groupBy(*by, field, "class").agg(F.count(F.lit(1)).alias("n"))
    values = pairs.groupBy(*by, field).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")
    )
    written = recorded(items, field)
    single = written & (F.col("classes") == 1)

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    return values.groupBy(*by).agg(
        F.count_if(written).alias("values"),
        F.count_if(single).alias("single_class_values"),
        total(F.lit(True)).alias("items"),
        total(written).alias("items_recorded"),
        total(single).alias("items_given_away"),
    ).withColumn(
        "share_given_away",
        F.round(F.col("items_given_away") / F.greatest("items", F.lit(1)), 4),
    )


def values_by_class(items: DataFrame, field: str) -> DataFrame:
    """Items, groups, classes and the class list behind each recorded value."""
    cells = items.filter(recorded(items, field)).groupBy(field, "class", "group_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = cells.groupBy(field, "class").agg(F.sum("n").alias("n"))
    named = pairs.groupBy(field).agg(
        F.sum("n").alias("items"),
        F.count(F.lit(1)).alias("classes"),
        F.array_join(F.array_sort(F.collect_list("class")), ", ").alias("carried"),
    )
    # A group may carry several classes, so groups are counted apart.
    groups = (
        cells.select(field, "group_id")
        .distinct()
        .groupBy(field)
        .agg(F.count(F.lit(1)).alias("groups"))
    )
    return named.join(groups, field).select(field, "items", "groups", "classes", "carried")


def class_value_counts(items: DataFrame, field: str) -> DataFrame:
    """Items and groups per class and recorded value."""
    cells = items.filter(recorded(items, field)).groupBy("class", field, "group_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return cells.groupBy("class", field).agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("groups")
    )


def tags_by_class(items: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Tag by class counts with a total and the number of classes that have any.

    One aggregate over the items gives a classes x tags table; only that is pivoted.
    """
    tags = tag_columns(items)
    sums = items.groupBy("class").agg(
        *[F.sum(F.col(t).cast("bigint")).alias(t[len(TAG_PREFIX) :]) for t in tags]
    )
    cells = sums.unpivot(["class"], [t[len(TAG_PREFIX) :] for t in tags], "tag", "n")
    table = cells.groupBy("tag").pivot("class", list(class_names)).agg(F.sum("n"))
    counts = [F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast("bigint") for name in class_names]
    total, having = F.lit(0).cast("bigint"), F.lit(0)
    for count in counts:
        total, having = total + count, having + (count > 0).cast("int")
    return table.select(
        "tag",
        *[count.alias(name) for count, name in zip(counts, class_names)],
        total.alias("total"),
        having.alias("classes_with_any"),
    )
