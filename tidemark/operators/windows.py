"""Cutting signals into windows, from array columns or from sample rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ExtractionIncomplete
from tidemark.functions.signal import (
    echo_places,
    pad_signal,
    silent_places,
    start_of,
    window_starts,
)
from tidemark.operators.joins import lookup
from tidemark.operators.ordered import with_position
from tidemark.parameters import Band


def split_windows(df: DataFrame, band: Band, signal: str = "signal") -> DataFrame:
    """One row per window of an array signal: ``(…, window_index, start, samples)``."""
    others = [name for name in df.columns if name != signal]
    ready = df.withColumn(
        "__padded", pad_signal(F.col(signal), band.window, band.pad_mode)
    ).select(*others, "__padded")
    starts = window_starts(F.size("__padded"), band.window, band.hop, band.max_windows)
    cut = ready.select("*", F.posexplode(starts).alias("window_index", "start"))
    return cut.select(
        *others,
        "window_index",
        "start",
        # An array has fewer than 2^31 places.
        F.slice("__padded", (F.col("start") + 1).cast("int"), band.window).alias("samples"),
    )


def number_samples(
    df: DataFrame, item: str, order: Sequence[str]
) -> DataFrame:
    """Zero-based ``position`` of every sample row in its item.

    An item may hold a large part of all samples; no task has to sort it alone.
    """
    return with_position(df, [item], [(name, True) for name in order])


def split_samples(
    samples: DataFrame, band: Band, item: str = "item_id", value: str = "value"
) -> DataFrame:
    """Windows of signals kept as rows: ``(item, window_index, offset, value)``.

    ``samples`` has ``(item, position, value)``. A sample finds its windows by
    arithmetic on its position, so no signal is gathered in one place; the start list
    of an item is looked up with the item's length. Signals shorter than a window
    repeat their samples as the padding mode says.
    """
    w, hop = band.window, band.hop
    lengths = samples.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    plans = lengths.select(item, "n", F.col("n").alias("m"))
    if band.max_windows:
        length = F.greatest("n", F.lit(w).cast("bigint"))
        starts = window_starts(length, w, hop, band.max_windows)
        plans = plans.withColumn("starts", starts)
    rows = lookup(
        samples.select(item, "position", value), plans, [item], "n", spread=[item, "position"]
    )
    # Where this sample lands in the padded signal: itself, and its echoes if short.
    # Silence belongs to no sample, so the first one brings it along.
    n, here = F.col("m"), F.col("position").cast("bigint")
    heard = F.col(value).cast("double")

    def sounded(places: Column, what: Column) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("place"), what.alias("__heard")))

    short = F.concat(
        sounded(echo_places(here, n, w, band.pad_mode), heard),
        sounded(silent_places(here, n, w, band.pad_mode), F.lit(0.0)),
    )
    itself = sounded(F.array(here), heard)
    placed = rows.select("*", F.inline(F.when(n >= w, itself).otherwise(short)))
    place = F.col("place")
    if band.max_windows:
        hits = F.filter(
            F.transform(
                "starts", lambda s, i: F.struct(i.alias("window_index"), s.alias("start"))
            ),
            lambda x: (x["start"] <= place) & (x["start"] > place - w),
        )
    else:
        last = F.greatest(n - w, F.lit(0))
        low = F.greatest(F.lit(0), F.ceil((place - w + 1) / hop)).cast("bigint")
        high = F.least(F.ceil(last / hop), F.floor(place / hop)).cast("bigint")
        # The tail-aligned window starts before its place on the grid.
        high = F.when(place >= last, F.ceil(last / hop).cast("bigint")).otherwise(high)
        hits = F.transform(
            F.sequence(low, high),
            lambda i: F.struct(
                i.alias("window_index"), start_of(i, n, w, hop).alias("start")
            ),
        )
        # Every place lies in a window because a hop is no longer than a window.
        hits = F.filter(hits, lambda x: (x["start"] <= place) & (x["start"] > place - w))
    return placed.select(item, "place", "__heard", F.inline(hits)).select(
        item,
        F.col("window_index").cast("bigint").alias("window_index"),
        (F.col("place") - F.col("start")).cast("int").alias("offset"),
        F.col("__heard").alias(value),
    )


def sample_window_stats(windows: DataFrame, item: str = "item_id", value: str = "value") -> DataFrame:
    """Mean, population std and 10th / 90th percentile of every window kept as rows."""
    return windows.groupBy(item, "window_index").agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.percentile(value, 0.1).alias("p10"),
        F.percentile(value, 0.9).alias("p90"),
    )


def window_summary(windows: DataFrame) -> DataFrame:
    """Windows, items and groups per class, through (class, group, item) counts."""
    items = windows.groupBy("class", "group_id", "item_id").agg(F.count(F.lit(1)).alias("w"))
    groups = items.groupBy("class", "group_id").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("i")
    )
    return groups.groupBy("class").agg(
        F.sum("w").alias("windows"), F.sum("i").alias("items"), F.count(F.lit(1)).alias("groups")
    )


def missing_items(kept: DataFrame, produced: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Kept items that produced no window, with the reason if one was recorded."""
    missing = kept.select("item_id").join(
        produced.select("item_id").distinct(), "item_id", "left_anti"
    )
    if errors is None:
        return missing.withColumn("error", F.lit("no windows"))
    reasons = errors.groupBy("item_id").agg(F.min("error").alias("error"))
    return missing.join(reasons, "item_id", "left").na.fill({"error": "no windows"})


def extract_complete(
    kept: DataFrame,
    produced: DataFrame,
    errors: DataFrame | None = None,
    *,
    allow_missing: bool = False,
) -> DataFrame:
    """The windows, or an error that names some of the items that failed."""
    if not allow_missing:
        failed = missing_items(kept, produced, errors).limit(10).collect()
        if failed:
            raise ExtractionIncomplete(f"items without windows: {[tuple(r) for r in failed]}")
    return produced
