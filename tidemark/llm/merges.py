"""Byte-pair merges of many words at once, on numpy matrices.

A word's symbols stand in a row; every pair of neighbours has a rank. In each step every
unfinished word of the block merges its best pair, the leftmost among equals, and only the
two pairs beside it get new ranks. That is the order of a priority queue per word, with
the queue replaced by a minimum over the row. Words longer than ``LONG`` keep a real queue.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

LONG = 256
NONE = np.int64(1) << 62
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Given word number, position of the left symbol and merged symbol, is the merge skipped?
Skip = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class PairTable:
    """Rank and merged symbol of a pair of symbols, as an open-addressed numpy table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 8).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.value = np.full(size, NONE, dtype=np.int64)
        value = (rank.astype(np.int64) << 24) | merged.astype(np.int64)
        waiting, step = np.arange(len(keys)), 0
        while len(waiting):
            at = (self._slot(keys[waiting]) + step) & (size - 1)
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, lead = np.unique(np.where(free, at, -1), return_index=True)
            lead = lead[free[lead]]
            self.keys[at[lead]], self.value[at[lead]] = keys[waiting[lead]], value[waiting[lead]]
            waiting, step = np.delete(waiting, lead), step + 1
        self.probes = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << 24 | merged`` of each pair, ``NONE`` where it has no merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.value[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at_open = (at[open_] + step) & (len(self.keys) - 1)
            held = self.keys[at_open]
            same = held == keys[open_]
            found[open_[same]] = self.value[at_open[same]]
            open_ = open_[~same & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return found


def _merge_block(table: PairTable, symbols: np.ndarray, length: np.ndarray, number: np.ndarray, skip: Skip | None) -> np.ndarray:
    """Merge a block of words in place; symbols that are gone become -1."""
    rows, width = symbols.shape
    best = np.full((rows, width), NONE, dtype=np.int64)
    if width > 1:
        row, at = np.nonzero(np.arange(width - 1)[None, :] < (length - 1)[:, None])
        value = table.find(symbols[row, at], symbols[row, at + 1])
        if skip is not None:
            known = np.flatnonzero(value != NONE)
            out = skip(number[row[known]], at[known], value[known] & 0xFFFFFF)
            value[known[out]] = NONE
        best[row, at] = value
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (rows, 1))
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (rows, 1))
    live = np.arange(rows)
    view = best
    while len(live):
        at = view.argmin(axis=1)
        value = view[np.arange(len(live)), at]
        going = value != NONE
        if going.sum() < 0.7 * len(live):
            live, view, at, value = live[going], view[going], at[going], value[going]
            going = np.ones(len(live), bool)
            if not len(live):
                break
        local = np.flatnonzero(going)
        row, at, value = live[local], at[local], value[local]
        gone = after[row, at]
        symbols[row, at] = value & 0xFFFFFF
        symbols[row, gone] = -1
        view[local, gone] = NONE
        onward = after[row, gone]
        after[row, at] = onward
        has = onward < length[row]
        before[row[has], onward[has]] = at[has]
        view[local, at] = NONE
        _rerank(table, symbols, view, local[has], row[has], at[has], onward[has], number, skip)
        back = before[row, at]
        has = back >= 0
        _rerank(table, symbols, view, local[has], row[has], back[has], at[has], number, skip)
    return symbols


def _rerank(table, symbols, view, local, row, left, right, number, skip) -> None:
    value = table.find(symbols[row, left], symbols[row, right])
    if skip is not None:
        known = np.flatnonzero(value != NONE)
        out = skip(number[row[known]], left[known], value[known] & 0xFFFFFF)
        value[known[out]] = NONE
    view[local, left] = value


def _merge_long(table: PairTable, symbols: np.ndarray, number: int, skip: Skip | None) -> np.ndarray:
    """The same for one long word, with a priority queue."""
    symbols, size = symbols.copy(), len(symbols)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        value = table.find(symbols[left], symbols[right])
        if skip is not None:
            known = np.flatnonzero(value != NONE)
            out = skip(np.full(len(known), number), left[known], value[known] & 0xFFFFFF)
            value[known[out]] = NONE
        return value

    first = ranks(np.arange(size - 1), np.arange(1, size))
    current = first.tolist() + [int(NONE)]
    queue = [(v, i) for i, v in enumerate(current) if v != NONE]
    heapq.heapify(queue)
    while queue:
        value, at = heapq.heappop(queue)
        if current[at] != value:
            continue
        gone = after[at]
        symbols[at], symbols[gone] = value & 0xFFFFFF, -1
        current[gone] = current[at] = int(NONE)
        after[at] = after[gone]
        pairs = []
        if after[at] < size:
            before[after[at]] = at
            pairs.append((at, after[at]))
        if before[at] >= 0:
            pairs.append((before[at], at))
        if pairs:
            for (left, _), v in zip(pairs, ranks(*(np.array(side) for side in zip(*pairs))).tolist()):
                current[left] = v
                if v != NONE:
                    heapq.heappush(queue, (v, left))
    return symbols


def merge_words(
    table: PairTable, symbols: np.ndarray, starts: np.ndarray, skip: Skip | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Merge words that lie behind one another in ``symbols``; ``starts`` has one entry more.

    Returns the merged symbols and their starts. ``skip`` is asked about every candidate
    with the word's number.
    """
    length = np.diff(starts)
    result = symbols.astype(np.int64)
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    width, done = 4, int(np.searchsorted(ordered, 1, side="right"))
    while done < len(order) and width <= LONG:
        stop = int(np.searchsorted(ordered, width, side="right"))
        step = max(1, (1 << 19) // width)
        for low in range(done, stop, step):
            words = order[low : min(stop, low + step)]
            size = length[words]
            inside = np.arange(width)[None, :] < size[:, None]
            place = (starts[words][:, None] + np.arange(width)[None, :])[inside]
            block = np.full((len(words), width), -1, dtype=np.int64)
            block[inside] = result[place]
            result[place] = _merge_block(table, block, size, words, skip)[inside]
        done, width = stop, width * 2
    for word in order[done:]:
        span = slice(starts[word], starts[word + 1])
        result[span] = _merge_long(table, result[span], int(word), skip)
    stays = result >= 0
    total = np.concatenate([[0], np.cumsum(stays)])
    return result[stays], total[starts]
