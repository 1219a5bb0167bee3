"""What the item table says about the collection: coverage, groups, concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows():
    return F.count(F.lit(1))


def coverage(items: DataFrame) -> DataFrame:
    """Items and groups per class, before and after the filters, and kept hours.

    Rows collapse to (class, group) first, so no distinct count expands the input.
    """
    cells = items.groupBy("class", "group_id").agg(
        _rows().alias("n"),
        F.count_if("keep").alias("kept"),
        F.sum(F.when(F.col("keep"), F.col("duration"))).alias("seconds"),
    )
    return cells.groupBy("class").agg(
        F.sum("n").alias("items"),
        _rows().alias("groups"),
        F.sum("kept").alias("kept_items"),
        F.count_if(F.col("kept") > 0).alias("kept_groups"),
        (F.coalesce(F.sum("seconds"), F.lit(0.0)) / 3600.0).alias("kept_hours"),
    )


def value_counts(items: DataFrame, field: str) -> DataFrame:
    """Items and groups per class and value of a field."""
    cells = items.groupBy("class", field, "group_id").agg(_rows().alias("n"))
    return cells.groupBy("class", field).agg(
        F.sum("n").alias("items"), _rows().alias("groups")
    )


def per_group(items: DataFrame) -> DataFrame:
    """One row per class and group; year and rate are those of its first item."""
    return items.groupBy("class", "group_id").agg(
        _rows().alias("items"),
        F.count_if("keep").alias("kept_items"),
        F.min_by("year", "item_id").alias("year"),
        F.min_by("native_rate", "item_id").alias("native_rate"),
        F.sum("duration").alias("seconds"),
    )


def dropped(items: DataFrame) -> DataFrame:
    """Items and groups per class and drop reason."""
    return value_counts(items.filter(~F.col("keep")), "drop_reason")


def cross_label_groups(items: DataFrame, studied: Sequence[str]) -> DataFrame:
    """Groups that carry more than one class in the whole archive.

    ``kept`` says whether a group still carries two of the studied classes once the
    filters have run. The sets hold class names only, so they are as small as the
    class list whatever the group holds.
    """
    study = F.array(*[F.lit(name) for name in studied])
    cells = items.groupBy("group_id", "class").agg(F.count_if("keep").alias("kept"))
    sets = cells.groupBy("group_id").agg(
        F.array_sort(F.collect_list("class")).alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("kept") > 0, F.col("class")))).alias("alive"),
    )
    under = F.array_intersect("names", study)
    return sets.filter(F.size("names") > 1).select(
        "group_id",
        F.size("names").cast("bigint").alias("n_classes"),
        F.array_join("names", ", ").alias("classes"),
        F.size(under).cast("bigint").alias("n_under_study"),
        F.array_join(under, ", ").alias("under_study"),
        (F.size(F.array_intersect("alive", study)) > 1).alias("kept"),
    )


def caveat_groups(cross: DataFrame) -> DataFrame:
    """Per studied class: surviving groups in which it shares a group with another."""
    mixed = cross.filter((F.col("n_under_study") >= 2) & F.col("kept"))
    named = mixed.select("group_id", F.explode(F.split("under_study", ", ")).alias("class"))
    return named.groupBy("class").agg(_rows().alias("shared_groups"))


def filter_loss(covered: DataFrame) -> DataFrame:
    """Groups lost to the filters per class, and their share."""
    lost = F.col("groups") - F.col("kept_groups")
    return covered.select(
        "class",
        "groups",
        "kept_groups",
        lost.alias("groups_lost"),
        F.round(lost / F.col("groups"), 3).alias("share_lost"),
    )


def concentration(groups: DataFrame) -> DataFrame:
    """Kept items per kept group, by class."""
    return (
        groups.filter(F.col("kept_items") > 0)
        .groupBy("class")
        .agg(
            _rows().alias("groups"),
            F.sum("kept_items").alias("items"),
            F.round(F.avg("kept_items"), 1).alias("items_per_group"),
        )
    )


def top_groups(groups: DataFrame, n: int = 10) -> DataFrame:
    """The n largest groups by kept items; ties by group, then class."""
    return (
        groups.filter(F.col("kept_items") > 0)
        .orderBy(F.desc("kept_items"), "group_id", "class")
        .limit(n)
        .select("class", "group_id", "year", "native_rate", "kept_items")
    )


def top_share(groups: DataFrame, n: int = 10) -> DataFrame:
    """Share of all kept items carried by the n largest groups (one row)."""
    top = top_groups(groups, n).agg(F.sum("kept_items").alias("part"))
    whole = groups.agg(F.sum("kept_items").alias("kept_items"))
    both = top.select("part", F.lit(None).cast("bigint").alias("kept_items")).unionByName(
        whole.select(F.lit(None).cast("bigint").alias("part"), "kept_items")
    )
    return both.agg(F.max("part").alias("top_items"), F.max("kept_items").alias("kept_items")).withColumn(
        "share", F.col("top_items") / F.greatest("kept_items", F.lit(1))
    )


def value_matrix(items: DataFrame, field: str, class_names: Sequence[str]) -> DataFrame:
    """Value by class counts, zero where a class never has the value."""
    counts = items.groupBy(field, "class").agg(_rows().alias("n"))
    return (
        counts.groupBy(field)
        .pivot("class", list(class_names))
        .agg(F.sum("n"))
        .na.fill(0, list(class_names))
    )
