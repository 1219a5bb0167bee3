"""Binary tag tasks posed inside one class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import TaskError
from tidemark.functions.notes import TAG_PREFIX, Vocabulary
from tidemark.operators.notes import (
    context_columns,
    items_with_notes,
    tag_columns,
    within_guard,
)

ABSENT, PRESENT = "absent", "present"
MIN_ITEMS, MIN_GROUPS = 60, 10


def task_items(
    items: DataFrame, notes: DataFrame, class_name: str, max_seconds: float | None = None
) -> DataFrame:
    """Kept items of one class with every tag and the recording context."""
    chosen = items.filter(F.col("keep") & (F.col("class") == class_name))
    # One join, so that the notes are parsed once.
    tagged = items_with_notes(chosen, notes, *tag_columns(notes), *context_columns(notes))
    return within_guard(tagged, max_seconds)


def require_items(df: DataFrame, what: str) -> DataFrame:
    """The items of a task, or an error: a plan that runs a task starts here."""
    if df.isEmpty():
        raise TaskError(f"no kept items for {what}")
    return df


def viable_tasks(
    labelled: DataFrame,
    vocabulary: Vocabulary,
    *,
    min_items: int = MIN_ITEMS,
    min_groups: int = MIN_GROUPS,
) -> DataFrame:
    """Tags with enough positive items over enough groups, for every class at once.

    Positives are counted after the tag's own length guard. Items collapse to
    (class, group) counts per tag in one pass; nothing is unpivoted before that.
    """
    tags = [name[len(TAG_PREFIX) :] for name in tag_columns(labelled)]

    def positive(tag: str):
        flag = F.coalesce(F.col(TAG_PREFIX + tag), F.lit(False))
        guard = vocabulary.guards.get(tag)
        return flag if guard is None else flag & (F.col("duration") <= guard)

    cells = labelled.groupBy("class", "group_id").agg(
        *[F.count_if(positive(tag)).alias(f"n_{tag}") for tag in tags]
    )
    sums = cells.groupBy("class").agg(
        *[F.sum(f"n_{tag}").alias(f"n_{tag}") for tag in tags],
        *[F.count_if(F.col(f"n_{tag}") > 0).alias(f"g_{tag}") for tag in tags],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(tag).alias("tag"),
                F.col(f"n_{tag}").alias("positives"),
                F.col(f"g_{tag}").alias("groups"),
                F.lit(vocabulary.guards.get(tag)).cast("double").alias("guard"),
            )
            for tag in tags
        ]
    )
    tasks = sums.select("class", F.inline(rows)).filter(
        (F.col("positives") >= min_items) & (F.col("groups") >= min_groups)
    )
    name = F.concat(F.lit("calltype_"), F.lower("class"), F.lit("_"), F.col("tag"))
    return tasks.withColumn("task", name).withColumn(
        "control", F.concat(F.col("task"), F.lit("_context"))
    )


def require_tasks(tasks: DataFrame) -> DataFrame:
    """The tasks from most to fewest groups, or an error if there are none."""
    if tasks.isEmpty():
        raise TaskError("no tag reaches the minimum number of items and groups")
    return tasks.orderBy(F.desc("groups"), F.desc("positives"), "task")


def relabel_windows(
    windows: DataFrame, labelled: DataFrame, tag: str, max_seconds: float | None = None
) -> DataFrame:
    """Windows of the task's items, labelled by whether the tag is present.

    Features travel in the window row, so only the label changes.
    """
    flags = within_guard(labelled, max_seconds).select(
        "item_id", F.coalesce(F.col(TAG_PREFIX + tag), F.lit(False)).alias("__present")
    )
    joined = windows.drop("label", "class").join(flags, "item_id")
    return joined.select(
        *[c for c in joined.columns if c != "__present"],
        F.col("__present").cast("int").alias("label"),
        F.when(F.col("__present"), PRESENT).otherwise(ABSENT).alias("class"),
    )
