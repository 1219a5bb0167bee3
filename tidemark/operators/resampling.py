"""Drawing groups with replacement, with nothing to shuffle but sums.

The groups of a slice are numbered 0, 1, ...; draw d of resample b is a digest of the number
``STRIDE * b + d`` and the seed, taken modulo the number of groups. So any task can know any
draw, no draw is sent anywhere, and a repeated task draws the same.

A slice of more than ``STRIDE`` groups needs more numbers than that. With ``own`` its draws have
numbers of 64 bits, ``2**32 * b + d``, so that no resample shares a draw with another one.

Without ``own`` such resamples have numbers in common with the next ones: resample b
is the numbers of neighbouring strides. Then a stride is drawn and summed once for all
resamples that hold it, and the work no longer grows with the groups. Such resamples are
each a fair draw but not independent of their neighbours, so an interval over G groups rests
on about ``resamples * STRIDE / G`` independent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import spread_out

#: Numbers from one resample's first draw to the next one's; groups whose cells a task holds.
STRIDE, BLOCK = 1 << 16, 1 << 18
#: Least resamples of one task, tasks that all resamples of a slice are dealt to while it has few blocks, and
#: neighbouring slices that a task sums from the same draws of their own.
PART, TASKS, TOGETHER = 250, 32, 8
#: Bytes of weights held at a time, and draws worked on at a time.
HELD, PIECE = 3 << 26, 1 << 14

# The multipliers of a public 32-bit finaliser, and of the seed.
FIRST, SECOND, SEEDED = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1
# Those of a public 64-bit finaliser, and of the seed: shift, multiplier, shift, multiplier, shift.
WIDE, WIDE_SEEDED = (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31), 0x9E3779B97F4A7C15


def finish(x: np.ndarray) -> np.ndarray:
    """Every bit of 32 depends on every other."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(FIRST)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(SECOND)
    return x ^ (x >> np.uint32(16))


def drawn(first: int, last: int, groups: int, seed: int) -> np.ndarray:
    """The groups that the numbers from ``first`` up to ``last`` draw."""
    salt = finish(np.array([(seed * SEEDED) & 0xFFFFFFFF], dtype=np.uint32))[0]
    told = np.arange(first, last, dtype=np.uint64).astype(np.uint32)
    return finish(told ^ salt) % np.uint32(groups)


def wide_salt(seed: int) -> int:
    """What the numbers of 64 bits are told apart by for each seed."""
    x = seed * WIDE_SEEDED % (1 << 64)
    for shift, factor in zip(WIDE[::2], (*WIDE[1::2], 1)):
        x = (x ^ (x >> shift)) * factor % (1 << 64)
    return x


def own_draws(resample: int, groups: int, seed: int) -> Iterator[np.ndarray]:
    """The groups that a resample draws by numbers of its own, some at a time; each is overwritten by the next."""
    salt, x, y = np.uint64(wide_salt(seed)), np.empty(PIECE, np.uint64), np.empty(PIECE, np.uint64)
    every = np.arange(PIECE, dtype=np.uint64)
    for low in range(0, groups, PIECE):
        n = min(PIECE, groups - low)
        told, other = x[:n], y[:n]
        np.add(every[:n], np.uint64((resample << 32) + low), out=told)
        np.bitwise_xor(told, salt, out=told)
        for shift, factor in zip(WIDE[::2], (*WIDE[1::2], None)):
            np.right_shift(told, np.uint64(shift), out=other)
            np.bitwise_xor(told, other, out=told)
            if factor is not None:
                np.multiply(told, np.uint64(factor), out=told)
        # The upper half as a share of the groups.
        np.right_shift(told, np.uint64(32), out=told)
        np.multiply(told, np.uint64(groups), out=told)
        np.right_shift(told, np.uint64(32), out=told)
        yield told.view(np.int64)


def _own_times(resample: int, groups: int, seed: int) -> np.ndarray:
    """How often a resample draws each group, in as few bytes as tell it."""
    for kind in (np.uint8, np.int32):
        times = np.zeros(groups, kind)
        for some in own_draws(resample, groups, seed):
            np.add.at(times, some, kind(1))
        # A number too large for its bytes would have begun again at 0.
        if int(times.sum(dtype=np.int64)) == groups:
            break
    return times


def _shared_times(groups: int, first: int, last: int, seed: int) -> Iterator[np.ndarray]:
    now, one = None, np.ones(STRIDE, np.int32)
    for resample in range(first, last):
        at = resample * STRIDE
        if now is None or groups <= 2 * STRIDE:
            now = np.bincount(drawn(at, at + groups, groups, seed), minlength=groups).astype(np.int32)
        else:
            # All but a stride at either end was there before.
            np.subtract.at(now, drawn(at - STRIDE, at, groups, seed).astype(np.intp), one)
            np.add.at(now, drawn(at + groups - STRIDE, at + groups, groups, seed).astype(np.intp), one)
        yield now


def _each_times(groups: int, first: int, last: int, seed: int, own: bool) -> Iterator[np.ndarray]:
    if own and groups > STRIDE:
        return (_own_times(resample, groups, seed) for resample in range(first, last))
    return _shared_times(groups, first, last, seed)


def group_times(groups: int, first: int, last: int, resamples: int, seed: int, own: bool = False) -> np.ndarray:
    """How often each group is drawn in the resamples from ``first`` on: ``(last - first) x groups``."""
    times = np.empty((last - first, groups), np.int32)
    for at, one in enumerate(_each_times(groups, first, last, seed, own)):
        times[at] = one
    return times


def part_size(groups: int, resamples: int) -> int:
    """Resamples of one task: fewer tasks for each block, where blocks are many."""
    parts = max(1, TASKS // -(-groups // BLOCK))
    return max(PART, -(-resamples // parts))


def _strides(strides: range, size: int, value: dict, lines: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """What the first ``size`` draws of each stride add to each cell: ``len(strides) x cells``.

    A block's rows are sorted by group; ``lines`` tells where each of its groups begins.
    """
    groups, low = int(value["groups"][0]), int(value["block"][0]) * BLOCK
    starts, ends = lines[:-1], lines[1:]
    sums = np.zeros((len(strides), cells))
    for at, stride in enumerate(strides if size else []):
        one = drawn(stride * STRIDE, stride * STRIDE + size, groups, seed)
        if len(starts) < groups:
            # Numbers below the block wrap around, and are past it.
            one = one - np.uint32(low)
            one = one[one < len(starts)]
        one = one.astype(np.intp)
        line, end = starts.take(one), ends.take(one)
        # The first cell of every group that was drawn, then the second, and so on.
        while len(line):
            more = line < end
            if not more.all():
                line, end = line[more], end[more]
            n = value["n"]
            sums[at] += np.bincount(value["code"].take(line), n if n is None else n.take(line), cells)
            line = line + 1
    return np.rint(sums).astype(np.int64)


def _own_sums(resamples: range, value: dict, size: int, code: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """What the draws of each resample, by numbers of its own, add to each cell: ``len(resamples) x cells``."""
    groups, low = int(value["groups"][0]), int(value["block"][0]) * BLOCK
    # Rows of a cell follow each other: a resample weighs each row by its group's times, and sums them.
    order = np.lexsort((value["draw"], code))
    place, n = (value["draw"][order] - low).astype(np.int32), value["n"][order]
    n = None if (n == 1).all() else n
    starts = np.searchsorted(code[order], np.arange(cells))
    sums = np.empty((len(resamples), cells), np.int64)
    for at, resample in enumerate(resamples):
        times = np.zeros(size, np.int32)
        for one in own_draws(resample, groups, seed):
            if size < groups:
                # Numbers below the block wrap around, and are past it.
                one = one - low
                one = one[one.view(np.uint64) < size]
            np.add.at(times, one, np.int32(1))
        weight = times.take(place)
        sums[at] = np.add.reduceat(weight if n is None else weight * n, starts, dtype=np.int64)
    return sums


def _summed(resamples: int, seed: int, own: bool = False):
    def summed(rows: pa.Table) -> pa.Table:
        value = {name: rows.column(name).to_numpy() for name in rows.column_names}
        groups, block, first = (int(value[name][0]) for name in ("groups", "block", "first"))
        last, (whole, rest) = min(first + part_size(groups, resamples), resamples), divmod(groups, STRIDE)
        # Slices of a task have the same groups: a cell of one is no cell of another.
        told, slices = np.unique(value["slice"], return_inverse=True)
        kinds, cell = np.unique(value["cell"], return_inverse=True)
        pair, code = np.unique(slices * len(kinds) + cell, return_inverse=True)
        size = min(BLOCK, groups - block * BLOCK)
        if own and groups > STRIDE:
            sums = _own_sums(range(first, last), value, size, code, len(pair), seed)
        else:
            order = np.argsort(value["draw"], kind="stable")
            value["code"], n = code[order], value["n"][order]
            value["n"] = None if (n == 1).all() else n.astype(float)
            # A line is a row of a group; groups of the block without rows have none.
            lines = np.searchsorted(value["draw"][order] - block * BLOCK, np.arange(size + 1))
            # A resample is ``whole`` strides and the first draws of one more.
            sums = _strides(range(first + whole, last + whole), rest, value, lines, len(pair), seed)
            if whole:
                each = _strides(range(first, last + whole - 1), STRIDE, value, lines, len(pair), seed)
                up_to = np.concatenate([np.zeros((1, len(pair)), np.int64), np.cumsum(each, axis=0)])
                sums += up_to[whole:] - up_to[:-whole]
        row, column = np.nonzero(sums)
        return pa.table(
            {
                "slice": told[pair // len(kinds)][column],
                "resample": (row + first).astype(np.int32),
                "cell": kinds[pair % len(kinds)][column],
                "n": sums[row, column],
            }
        )

    return summed


def resampled_counts(cells: DataFrame, resamples: int, seed: int, own: bool = False) -> DataFrame:
    """``slice, resample, cell, n`` from ``slice, groups, draw, cell, n``.

    ``draw`` is the number of a group within its slice of ``groups`` groups and ``cell`` is any
    code of what is counted. A block of groups is summed in a task for some of the
    resamples, or all of them where blocks are many, from the draws that fall on it; only the sums are
    shuffled. With ``own`` all draws of a large slice are made for each of its blocks, so neighbouring
    slices of as many groups are summed together.
    """
    if resamples > 1 << 16:
        raise ValueError("at most 65536 resamples can be told apart")
    parts = F.greatest(F.lit(1), F.floor(F.lit(TASKS) / F.ceil(F.col("groups") / BLOCK)))
    size = F.greatest(F.lit(PART), F.ceil(F.lit(resamples) / parts)).cast("int")
    spread = cells.select(
        F.col("slice").cast("bigint"),
        F.col("groups").cast("bigint"),
        F.col("draw").cast("bigint"),
        F.col("cell").cast("bigint"),
        F.col("n").cast("bigint"),
        F.floor(F.col("draw") / BLOCK).cast("bigint").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), size)).alias("first"),
    ).withColumn("__set", F.floor(F.col("slice") / (TOGETHER if own else 1)))
    task = ["__set", "groups", "block", "first"]
    # All draws are made for a few rows: Spark would leave small ones to few tasks.
    summed = (spread_out(spread, *task) if own else spread).groupBy(*task).applyInArrow(
        _summed(resamples, seed, own), "slice bigint, resample int, cell bigint, n bigint"
    )
    return summed.groupBy("slice", "resample", "cell").agg(F.sum("n").alias("n"))


def _few_bytes(groups: int, first: int, last: int, seed: int, own: bool) -> np.ndarray:
    """``group_times`` in as few bytes as tell them."""
    times = np.empty((last - first, groups), np.uint8)
    for at, one in enumerate(_each_times(groups, first, last, seed, own)):
        if one.max(initial=0) > np.iinfo(times.dtype).max:
            times = times.astype(np.int32)
        times[at] = one
    return times


def resample_slices(groups: int, resamples: int, seed: int, own: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """All resamples in turn, as many at a time as may be held: ``(first, times)``."""
    step = max(1, HELD // max(groups, 1))
    for first in range(0, resamples, step):
        # Not named here, so that the caller may let go of it.
        yield first, _few_bytes(groups, first, min(first + step, resamples), seed, own)
