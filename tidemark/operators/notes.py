"""Notes as columns: parsing, re-parsing on drift, and joining the context on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import require_columns
from tidemark.functions.notes import (
    CONDITION_PREFIX,
    TAG_PREFIX,
    Vocabulary,
    coordinate_of,
    leading_code,
    site_of,
    tag_note,
)
from tidemark.sources.sets import commit_set, read_sets

CONTEXT = ("site", "lat", "lon", "code")


def tag_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name.startswith(TAG_PREFIX)]


def condition_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name.startswith(CONDITION_PREFIX)]


def note_columns(vocabulary: Vocabulary) -> list[str]:
    """Every column derived from the note text."""
    return ["code", "n_call_types", *vocabulary.flag_names()]


def flag_note(df: DataFrame, vocabulary: Vocabulary, note: str = "note") -> DataFrame:
    """Add the columns derived from the note; the note is read once per row."""
    tagged = df.withColumn("__tags", tag_note(F.col(note), vocabulary))
    flags = {name: F.array_contains("__tags", name) for name in vocabulary.flag_names()}
    count = F.size(F.filter("__tags", lambda tag: F.startswith(tag, F.lit(TAG_PREFIX))))
    return tagged.withColumns(
        {"code": leading_code(F.col(note)), "n_call_types": count, **flags}
    ).drop("__tags")


def annotate(raw: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per item out of ``(record_number, display_name, note, location)``."""
    require_columns(raw, "record_number", "display_name", "note", "location")
    placed = raw.select(
        F.col("record_number").cast("string").alias("item_id"),
        F.col("display_name").alias("class"),
        site_of(F.col("location")).alias("site"),
        coordinate_of(F.col("location"), "lat").alias("lat"),
        coordinate_of(F.col("location"), "lon").alias("lon"),
        F.coalesce("note", F.lit("")).alias("note"),
    )
    return flag_note(placed, vocabulary)


def reparse(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Recompute every note-derived column from the stored note, keeping the rest."""
    stale = set(note_columns(vocabulary)) | set(tag_columns(df)) | set(condition_columns(df))
    return flag_note(df.drop(*stale), vocabulary)


def reparse_on_drift(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The stored annotations, recomputed only if the vocabulary asks for more columns."""
    if set(note_columns(vocabulary)) <= set(df.columns):
        return df
    return reparse(df, vocabulary)


def healed(spark: SparkSession, root: str, config: str, vocabulary: Vocabulary, name: str = "annotations") -> DataFrame:
    """The committed annotations, recomputed and committed anew if the vocabulary asks for more.

    Whoever reads the older version meanwhile keeps it; without drift nothing is written.
    """
    stored = read_sets(spark, root, name, config=config, models=[name]).drop("config", "model", "classes")
    fresh = reparse_on_drift(stored, vocabulary)
    if fresh is stored:
        return stored
    commit_set({name: fresh}, root, config, name)
    return read_sets(spark, root, name, config=config, models=[name]).drop("config", "model", "classes")


def context_columns(notes: DataFrame) -> list[str]:
    """Columns that describe the recording rather than what is heard on it."""
    return [*CONTEXT, *condition_columns(notes)]


def attach_context(df: DataFrame, notes: DataFrame, item: str = "item_id") -> DataFrame:
    """Left join the recording context onto items or windows.

    ``notes`` has one row per item; an item with very many windows is split by
    adaptive skew handling, and a small ``notes`` is broadcast once its size is known.
    """
    columns = context_columns(notes)
    require_columns(notes, item, *columns)
    return df.join(notes.select(item, *columns), item, "left")


def items_with_notes(items: DataFrame, notes: DataFrame, *columns: str) -> DataFrame:
    """Left join the named note columns (all that items lack, by default) onto items."""
    wanted = list(columns) or [c for c in notes.columns if c not in items.columns]
    require_columns(notes, "item_id", *wanted)
    return items.join(notes.select("item_id", *wanted), "item_id", "left")


def within_guard(df: DataFrame, seconds: float | None, duration: str = "duration") -> DataFrame:
    """Drop the items too long for their label to describe every window of them."""
    return df if seconds is None else df.filter(F.col(duration) <= seconds)


def tags_per_class(notes: DataFrame) -> DataFrame:
    """``(class, tag, items)`` for every tag seen at least once in a class."""
    tags = tag_columns(notes)
    sums = notes.groupBy("class").agg(
        *[F.sum(F.col(t).cast("bigint")).alias(t[len(TAG_PREFIX) :]) for t in tags]
    )
    return sums.unpivot(
        ["class"], [t[len(TAG_PREFIX) :] for t in tags], "tag", "items"
    ).filter(F.col("items") > 0)


def annotation_summary(notes: DataFrame) -> DataFrame:
    """Items, untagged items and distinct sites per class (a blank site is a value)."""
    by_site = notes.groupBy("class", "site").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_call_types") == 0).alias("untagged"),
    )
    return by_site.groupBy("class").agg(
        F.sum("n").alias("items"),
        F.sum("untagged").alias("untagged"),
        F.count("site").alias("sites"),
    )
