"""Array expressions on one signal: padding, window starts, simple statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_count(n: Column, window: int, hop: int) -> Column:
    """How many windows cover ``n`` samples, the tail-aligned last one included."""
    beyond = F.greatest(n - window, F.lit(0))
    return F.ceil(beyond / hop) + 1


def start_of(i: Column, n: Column, window: int, hop: int) -> Column:
    """Where window ``i`` starts: on the hop grid, but never past the last full window."""
    return F.least(i * hop, F.greatest(n - window, F.lit(0)))


def window_starts(n: Column, window: int, hop: int, max_windows: int = 0) -> Column:
    """Start offsets that cover ``n`` samples, with a tail-aligned last window.

    More than ``max_windows`` starts are thinned to that many evenly spaced ones,
    rounding half to even and always ending on the last; the full list is not built
    for that.
    """
    if window <= 0 or hop <= 0:
        raise ValueError("window and hop must be positive")
    n = n.cast("bigint")
    count = window_count(n, window, hop)
    every = F.sequence(F.lit(0).cast("bigint"), count - 1)
    if max_windows == 1:
        chosen = F.array(F.lit(0).cast("bigint"))
    elif max_windows:
        step = (count - 1) / F.lit(max_windows - 1)
        picks = F.transform(
            F.sequence(F.lit(0), F.lit(max_windows - 1)),
            lambda i: F.when(i == max_windows - 1, count - 1).otherwise(
                F.rint(i * step).cast("bigint")
            ),
        )
        chosen = F.when(count > max_windows, F.array_distinct(picks)).otherwise(every)
    else:
        chosen = every
    return F.transform(chosen, lambda i: start_of(i, n, window, hop))


def pad_index(i: Column, n: Column, mode: str) -> Column:
    """Where sample ``i`` of the padded signal comes from; null means silence."""
    if mode == "reflect":
        period = F.greatest(2 * (n - 1), F.lit(1))
        phase = i % period
        source = F.least(phase, period - phase)
    elif mode == "wrap":
        source = i % F.greatest(n, F.lit(1))
    elif mode == "edge":
        source = F.least(i, n - 1)
    elif mode == "constant":
        source = F.lit(None).cast("int")
    else:
        raise ValueError(f"unknown padding mode {mode!r}")
    # One sample leaves nothing to bounce between, so it falls back to silence.
    return F.when(i < n, i).when(n > 1, source)


def echo_places(p: Column, n: Column, length: int, mode: str) -> Column:
    """Places below ``length`` where sample ``p`` of a short signal sounds, itself included."""
    none = F.array().cast("array<bigint>")

    def every(start: Column, step: Column) -> Column:
        last = F.lit(length - 1).cast("bigint")
        return F.when(start <= last, F.sequence(start, last, step)).otherwise(none)

    alone = F.array(p)
    if mode == "reflect":
        period = F.greatest(2 * (n - 1), F.lit(1).cast("bigint"))
        back = F.when((p > 0) & (p < n - 1), every(period - p, period)).otherwise(none)
        echoes = F.concat(every(p, period), back)
    elif mode == "wrap":
        echoes = every(p, n)
    elif mode == "edge":
        echoes = F.when(p == n - 1, every(p, F.lit(1).cast("bigint"))).otherwise(alone)
    elif mode == "constant":
        echoes = alone
    else:
        raise ValueError(f"unknown padding mode {mode!r}")
    return F.when(n > 1, echoes).otherwise(alone)


def silent_places(p: Column, n: Column, length: int, mode: str) -> Column:
    """Places below ``length`` where a short signal is silent, listed for its first sample."""
    none = F.array().cast("array<bigint>")
    rest = F.sequence(n, F.lit(length - 1).cast("bigint"))
    silent = (p == 0) & (n < length)
    if mode != "constant":
        silent = silent & (n <= 1)
    return F.when(silent, rest).otherwise(none)


def pad_signal(signal: Column, length: int, mode: str = "reflect") -> Column:
    """Extend a short signal to ``length`` samples; a longer one is left alone."""
    n = F.size(signal)
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.coalesce(F.get(signal, pad_index(i, n, mode)), F.lit(0.0)),
    )
    return F.when(n >= length, signal).otherwise(padded)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def population_std(values: Column) -> Column:
    centre = mean(values)
    return F.sqrt(_sum(F.transform(values, lambda v: (v - centre) * (v - centre))) / F.size(values))


def percentile(values: Column, q: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    ordered = F.array_sort(values)
    place = (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    return F.get(ordered, low) + (F.get(ordered, high) - F.get(ordered, low)) * (place - low)


def series_stats(values: Column) -> Column:
    """Struct of mean, population std, 10th and 90th percentile."""
    return F.struct(
        mean(values).alias("mean"),
        population_std(values).alias("std"),
        percentile(values, 0.1).alias("p10"),
        percentile(values, 0.9).alias("p90"),
    )


def frames(values: Column, length: int, hop: int) -> Column:
    """Un-centred frames of a window."""
    last = F.size(values) - length
    return F.transform(
        F.sequence(F.lit(0), last, F.lit(hop)), lambda s: F.slice(values, s + 1, length)
    )


def frame_rms(values: Column, length: int, hop: int) -> Column:
    return F.transform(
        frames(values, length, hop),
        lambda f: F.sqrt(_sum(F.transform(f, lambda v: v * v)) / length),
    )


def frame_crossings(values: Column, length: int, hop: int) -> Column:
    """Share of samples whose sign differs from the sample before (zero counts as up)."""

    def crossings(f: Column) -> Column:
        pairs = F.zip_with(
            F.slice(f, 1, length - 1),
            F.slice(f, 2, length - 1),
            lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0),
        )
        return _sum(pairs) / length

    return F.transform(frames(values, length, hop), crossings)


def standardise(values: Column) -> Column:
    """Subtract the mean; divide by the population std unless it is next to nothing."""
    centre, spread = mean(values), population_std(values)
    return F.transform(
        values, lambda v: F.when(spread > 1e-6, (v - centre) / spread).otherwise(v - centre)
    )
