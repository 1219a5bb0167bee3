"""Ranking metrics from one sorted layout of (view, class, score).

A *view* is a slice scored over one set of present classes. Rows become entries, a class
each. A class of a view with many entries is cut into buckets of falling score, so that no view
has to be sorted by one task.

Without draws a task sorts the rows that it reads and writes its entries as runs: one short row of
byte strings for each view, class and bucket, equal scores together. Runs, not entries, are
shuffled. The totals of runs give what lies above a bucket, and a bucket is merged by one task.

Entries may carry a unit, the number of the group that their row belongs to. Then every
sum is a vector with a number for each resample, weighted by how often it drew the unit: the
rows are sorted once for all resamples. These entries are collapsed where they are and
range-partitioned by view, class and falling score; in that very stage each partition packs
its entries into short rows of arrays (``CHUNK`` entries, ties together), which are written. All
later steps read those. A task makes its draws once for as many chunks as it may hold, and gives the
sums and the pairs won of each; pairs between chunks follow from running sums, so the AUC
takes one pass. Only precisions need a second one, with the running sums of chunks before.
Nothing as long as the entries is shuffled a second time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import durable
from tidemark.operators.resampling import resample_slices

CHUNK = 1 << 15
#: What the entries of a view are for: both metrics, or one of them where classes are absent.
BOTH, AUC, AP = 0, 1, 2
AUC_NAME, AP_NAME = "roc_auc_ovr_macro", "average_precision_macro"
#: Weights that are worked on at a time, and weights of a line of entries that are counted together.
IN_CACHE, LINE = 1 << 17, 1 << 14
#: Entries that a task draws for at a time.
HELD_ENTRIES = 1 << 24
#: Rows that a task sorts at a time, entries of a bucket, and how many of them place its bounds.
HELD_ROWS, BUCKET, PLACING = 1 << 19, 1 << 21, 4000

_ENTRY = "view bigint, k int, score double, unit int, pos bigint, neg bigint"
_CHUNK = "view bigint, k int, seq bigint, unit array<int>, pos array<bigint>, neg array<bigint>, ends array<int>"
_RUN = "view bigint, k int, bucket int, pos bigint, neg bigint, score binary, hits binary, misses binary"
_SUMS = "view bigint, k int, seq bigint, resample int, won double, pos double, neg double"
_PRECISE = "view bigint, k int, resample int, precise double"
_AREAS = "view bigint, k int, resample int, won double, precise double, pos double, neg double"


@dataclass(frozen=True)
class Draws:
    """The groups of every view are drawn ``resamples`` times; units are their numbers.

    ``own`` says that resamples share no draws, however many groups there are.
    """

    resamples: int
    seed: int
    own: bool = True


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def _collapsed(view, k, score, unit, pos, neg) -> pa.RecordBatch:
    """Entries that share view, class, score and unit become one."""
    order = np.lexsort((unit, score, k, view))
    view, k, score, unit, pos, neg = (x[order] for x in (view, k, score, unit, pos, neg))
    fresh = np.ones(len(view), dtype=bool)
    fresh[1:] = (view[1:] != view[:-1]) | (k[1:] != k[:-1]) | (score[1:] != score[:-1]) | (unit[1:] != unit[:-1])
    at = np.flatnonzero(fresh)
    kept = (view[at], k[at], score[at], unit[at], np.add.reduceat(pos, at), np.add.reduceat(neg, at))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["view", "k", "score", "unit", "pos", "neg"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of class scores as rows; what is null or missing is not a number."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    whole = np.full((len(size), width), np.nan)
    whole[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return whole


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row as an entry for each view of its slice and each class of the view."""
    for batch in batches:
        if not batch.num_rows:
            continue
        probs = _matrix(batch.column("probs"))
        label, unit, mass, own = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("label", "unit", "mass", "slice"))
        parts = []
        for one in np.unique(own):
            at = np.flatnonzero(own == one)
            for view in batch.column("views")[int(at[0])].as_py():
                present = view["present"]
                scores = probs[at][:, present]
                if view["kind"] == AUC:
                    total = scores.sum(axis=1, keepdims=True)
                    scores = np.where(total > 0, scores / np.where(total > 0, total, 1), 1 / len(present))
                # Of two classes the AUC is that of the second.
                first = 1 if view["kind"] == AUC and len(present) == 2 else 0
                for place in range(first, len(present)):
                    mine, score = label[at] == present[place], scores[:, place]
                    good = ~np.isnan(score)
                    n = int(good.sum())
                    parts.append(
                        (
                            np.full(n, view["view"], np.int64),
                            np.full(n, present[place], np.int32),
                            score[good] + 0.0,
                            unit[at][good],
                            np.where(mine, mass[at], 0)[good],
                            np.where(mine, 0, mass[at])[good],
                        )
                    )
        if parts:
            yield _collapsed(*(np.concatenate(column) for column in zip(*parts)))


class _Packer:
    """Sorted entries in, chunks out; a chunk ends where a score ends."""

    def __init__(self, single: bool):
        self.single, self.key, self.held, self.size = single, None, [], 0

    def add(self, key: tuple[int, int], columns: list[np.ndarray]) -> Iterator[tuple]:
        if key != self.key:
            yield from self.flush()
            self.key = key
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= CHUNK:
            yield from self.flush(keep_last=True)

    def flush(self, keep_last: bool = False) -> Iterator[tuple]:
        if not self.held:
            return
        score, unit, pos, neg = (np.concatenate(column) for column in zip(*self.held))
        fresh = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        self.held, self.size = [], 0
        if keep_last:
            # The last score may go on in the next batch.
            last = fresh[-1]
            self.held, self.size = [[x[last:] for x in (score, unit, pos, neg)]], len(score) - last
            score, unit, pos, neg, fresh = score[:last], unit[:last], pos[:last], neg[:last], fresh[:-1]
        if not len(fresh):
            return
        if self.single:
            pos, neg, unit = np.add.reduceat(pos, fresh), np.add.reduceat(neg, fresh), unit[fresh]
            ends = np.arange(1, len(fresh) + 1)
        else:
            ends = np.append(fresh[1:], len(score))
        for low in range(0, len(ends), CHUNK):
            some = ends[low : low + CHUNK]
            begin = ends[low - 1] if low else 0
            part = slice(begin, some[-1])
            yield (*self.key, unit[part], pos[part], neg[part], (some - begin).astype(np.int32))


def _pack(single: bool):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seq = _Packer(single), 0

        def told(chunks) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for view, k, unit, pos, neg, ends in chunks:
                lists = [
                    pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                    for x, kind in ((unit, pa.int32()), (pos, pa.int64()), (neg, pa.int64()), (ends, pa.int32()))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([view], pa.int64()), pa.array([k], pa.int32()), pa.array([seq], pa.int64()), *lists],
                    names=["view", "k", "seq", "unit", "pos", "neg", "ends"],
                )
                seq += 1

        for batch in batches:
            view, k, score, unit, pos, neg = _numbers(batch)
            if not len(view):
                continue
            cuts = np.flatnonzero((view[1:] != view[:-1]) | (k[1:] != k[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(view)]):
                part = slice(low, high)
                yield from told(packer.add((view[low], k[low]), [score[part], unit[part], pos[part], neg[part]]))
        yield from told(packer.flush())

    return packed


class _Chunk:
    """A chunk made ready for many resamples: what its hits are, and where their ties begin and end."""

    def __init__(self, unit: np.ndarray, pos: np.ndarray, neg: np.ndarray, ends: np.ndarray):
        mass, starts = pos + neg, np.concatenate([[0], ends[:-1]])
        self.hit = np.flatnonzero(pos)
        first, last = np.searchsorted(self.hit, starts), np.searchsorted(self.hit, ends)
        some = last > first
        self.unit, self.most = unit, int(mass.sum())
        self.mass = None if (mass == 1).all() else mass
        self.worth = None if (pos[self.hit] == 1).all() else pos[self.hit]
        self.starts, self.ends, self.first, self.last = starts[some], ends[some], first[some], last[some]

    def weighed(self, times: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Running sums of all and of the hits, each after a 0, for some resamples at a time."""
        kind = np.int32 if self.most * int(times.max(initial=0)) < 1 << 31 else np.int64
        step = max(1, IN_CACHE // len(self.unit))
        for low in range(0, len(times), step):
            weight = times[low : low + step].take(self.unit, axis=1)
            hits = weight.take(self.hit, axis=1)
            found = []
            for x, worth in ((weight, self.mass), (hits, self.worth)):
                sums = np.zeros((len(x), x.shape[1] + 1), kind)
                np.cumsum(x if worth is None else x * worth, axis=1, dtype=kind, out=sums[:, 1:])
                found.append(sums)
            yield slice(low, low + len(weight)), *found

    def sums(self, times: np.ndarray, won: bool) -> list[np.ndarray]:
        """Pairs won inside the chunk, hits and misses, a number for each resample."""
        told = np.zeros((3, len(times)))
        for at, every, hits in self.weighed(times):
            told[1, at], told[2, at] = hits[:, -1], every[:, -1] - hits[:, -1]
            if won:
                low, high = hits.take(self.first, axis=1), hits.take(self.last, axis=1)
                missed = every.take(self.starts, axis=1) - low + (every.take(self.ends, axis=1) - high)
                lost = np.einsum("ij,ij->i", (high - low).astype(float), missed.astype(float)) / 2
                told[0, at] = told[1, at] * told[2, at] - lost
        return list(told)

    def precise(self, times: np.ndarray, above_pos: np.ndarray, above_neg: np.ndarray) -> np.ndarray:
        """Precision summed over hits."""
        told = np.zeros(len(times))
        for at, every, hits in self.weighed(times):
            low, high, passed = hits.take(self.first, axis=1), hits.take(self.last, axis=1), every.take(self.ends, axis=1)
            above = above_pos[at, None]
            told[at] = ((high - low) * (above + high) / np.maximum(above + above_neg[at, None] + passed, 1)).sum(axis=1)
        return told


class _Pairs:
    """A chunk made ready to count the pairs it wins, for many resamples at once.

    Hits stand before the misses of their score and once more after them, so a miss meets
    those of its score once, and those above twice.
    """

    def __init__(self, unit: np.ndarray, pos: np.ndarray, neg: np.ndarray, ends: np.ndarray):
        score = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) * 3
        hit, miss = np.flatnonzero(pos), np.flatnonzero(neg)
        order = np.argsort(np.concatenate([score[hit], score[miss] + 1, score[hit] + 2]), kind="stable")
        worth = np.concatenate([pos[hit], neg[miss], pos[hit]])[order]
        self.unit, self.heaviest = unit[np.concatenate([hit, miss, hit])[order]], int(worth.max(initial=1))
        self.first = np.concatenate([np.ones(len(hit), bool), np.zeros(len(miss), bool), np.ones(len(hit), bool)])[order]
        self.worth = worth if self.heaviest > 1 else None

    def sums(self, times: np.ndarray, top: int) -> list[np.ndarray]:
        """Pairs won inside the chunk, hits and misses; ``times`` has a row for each group and is ``top`` at most.

        Blocks of entries are counted in small whole numbers, the first entries of all blocks, then the
        second ones, and so on; blocks follow each other by their sums.
        """
        # A block's hits times its misses are below the square of half its weight.
        small = [size for size in (32, 16, 8, 4) if size * top * self.heaviest < 512]
        kind, size, count = (np.uint16 if small else np.int64), (small or [32])[0], times.shape[1]
        told, step = np.zeros((3, count)), size * max(1, LINE // count)
        for low in range(0, len(self.unit), step):
            unit = self.unit[low : low + step]
            blocks = -(-len(unit) // size)
            place, mass, first = (np.zeros(blocks * size, x) for x in (np.intp, kind, kind))
            # What is past the last entry weighs nothing.
            place[: len(unit)], first[: len(unit)] = unit, self.first[low : low + step]
            mass[: len(unit)] = 1 if self.worth is None else self.worth[low : low + step]
            place, mass, first = (x.reshape(blocks, size).T.ravel() for x in (place, mass, first))
            missed = times.take(place, axis=0).astype(kind)
            if self.worth is not None or len(unit) < len(place):
                missed *= mass[:, None]
            # All bits of the hits, none of the misses.
            hits = missed & (0 - first)[:, None]
            missed -= hits
            hits, missed = hits.reshape(size, -1), missed.reshape(size, -1)
            above, won, now = hits[0].copy(), np.zeros_like(hits[0]), np.empty_like(hits[0])
            for at in range(1, size):
                np.multiply(above, missed[at], out=now)
                won += now
                above += hits[at]
            pos, neg = (x.reshape(blocks, count).astype(float) for x in (above, missed.sum(axis=0, dtype=kind)))
            reached, below = np.cumsum(pos, axis=0), neg.sum(axis=0)
            told[0] += won.reshape(blocks, count).sum(axis=0, dtype=float)
            told[0] += np.einsum("ij,ij->j", reached - pos, neg) + told[1] * below
            told[1] += reached[-1]
            told[2] += below
        return [told[0] / 2, told[1] / 2, told[2]]


def _chunks(batch: pa.RecordBatch, made: type) -> Iterator[tuple]:
    lists = {name: batch.column(name) for name in ("unit", "pos", "neg", "ends")}
    ids = zip(*(batch.column(name).to_pylist() for name in ("view", "k", "seq")))
    for row, own in enumerate(ids):
        yield own, made(*(lists[name][row].values.to_numpy(zero_copy_only=False) for name in lists))


def _drawn(batch: pa.RecordBatch, draws: Draws) -> Iterator[tuple]:
    """``(row, (view, k, seq), chunk, resamples, times)``: how often each wanted resample drew each group."""
    chunks = list(_chunks(batch, _Chunk))
    groups, wanted = batch.column("groups").to_pylist(), batch.column("resamples")
    for count in sorted(set(groups)):
        for first, times in resample_slices(count, draws.resamples, draws.seed, draws.own):
            for row, (own, chunk) in enumerate(chunks):
                mine = _asked(wanted[row], first, times)
                if groups[row] == count and len(mine):
                    yield row, own, chunk, mine, times if len(mine) == len(times) else times[mine - first]


def _asked(wanted: pa.ListScalar, first: int, times: np.ndarray) -> np.ndarray:
    wanted = wanted.values.to_numpy(zero_copy_only=False)
    return wanted[(wanted >= first) & (wanted < first + len(times))]


def _held_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """``(view, k, seq), pairs, groups, resamples`` of as many chunks as may be held."""
    held, size = [], 0
    for batch in batches:
        groups, wanted = batch.column("groups").to_pylist(), batch.column("resamples")
        for row, (own, chunk) in enumerate(_chunks(batch, _Pairs)):
            held.append((own, chunk, groups[row], wanted[row]))
            size += len(chunk.unit)
            if size >= HELD_ENTRIES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _run_pairs(draws: Draws, held: list[tuple]) -> Iterator[tuple]:
    """``(view, k, seq), resamples, sums`` of chunks that follow each other at once."""
    runs, before = [], None
    for one in sorted(held, key=lambda one: one[0]):
        view, k, seq = one[0]
        if before == (view, k, seq - 1):
            runs[-1].append(one)
        else:
            runs.append([one])
        before = view, k, seq
    for count in sorted({one[2] for one in held}):
        for first, times in resample_slices(count, draws.resamples, draws.seed, draws.own):
            last, asked, own = first + len(times), None, None
            # A group's weights lie side by side.
            rows, top = np.ascontiguousarray(times.T), int(times.max(initial=0))
            mine_of = [_asked(run[0][3], first, times) for run in runs]
            del times
            for run, mine in zip(runs, mine_of):
                if run[0][2] != count or not len(mine):
                    continue
                if asked is None or not np.array_equal(asked, mine):
                    asked, own = mine, rows if len(mine) == last - first else rows[:, mine - first]
                won, pos, neg = np.zeros((3, len(mine)))
                for _, chunk, *_ in run:
                    told = chunk.sums(own, top)
                    won += told[0] + pos * told[2]
                    pos, neg = pos + told[1], neg + told[2]
                yield run[0][0], mine, (won, pos, neg)


def _chunk_sums(draws: Draws, batch: pa.RecordBatch, metric: str | None) -> Iterator[tuple]:
    for _, own, chunk, resamples, times in _drawn(batch, draws):
        yield own, resamples, chunk.sums(times, metric != AP_NAME)


def _sums(draws: Draws, metric: str | None):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if metric == AUC_NAME:
            found = (one for held in _held_chunks(batches) for one in _run_pairs(draws, held))
        else:
            found = (one for batch in batches for one in _chunk_sums(draws, batch, metric))
        for (view, k, seq), resamples, told in found:
            n = len(resamples)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, view), pa.int64()),
                    pa.array(np.full(n, k), pa.int32()),
                    pa.array(np.full(n, seq), pa.int64()),
                    pa.array(resamples, pa.int32()),
                    *(pa.array(x, pa.float64()) for x in told),
                ],
                names=["view", "k", "seq", "resample", "won", "pos", "neg"],
            )

    return summed


def _area(pos: np.ndarray, neg: np.ndarray, above_pos, above_neg, metric: str | None) -> list[np.ndarray]:
    """Pairs won, precision summed over hits, and the sums, a row for each resample."""
    reached, none = above_pos + np.cumsum(pos, axis=1), np.zeros(len(pos))
    won = none if metric == AP_NAME else np.einsum("ij,ij->i", neg, reached - pos / 2)
    precise = none
    if metric != AUC_NAME:
        precise = (pos * reached / np.maximum(reached + above_neg + np.cumsum(neg, axis=1), 1)).sum(axis=1)
    return [won, precise, pos.sum(axis=1), neg.sum(axis=1)]


def _precisions(draws: Draws):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("before")
            for row, (view, k, _), chunk, resamples, times in _drawn(batch, draws):
                told = before[row].values
                at = np.searchsorted(told.field("resample").to_numpy(), resamples)
                above = [told.field(name).to_numpy()[at] for name in ("pos", "neg")]
                n = len(resamples)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, view), pa.int64()),
                        pa.array(np.full(n, k), pa.int32()),
                        pa.array(resamples, pa.int32()),
                        pa.array(chunk.precise(times, *above), pa.float64()),
                    ],
                    names=["view", "k", "resample", "precise"],
                )

    return scored


def _view_scores(probs: np.ndarray, label: np.ndarray, mass: np.ndarray, kind: int, present: Sequence[int]) -> Iterator[tuple]:
    """``(class, score, hits, misses)`` of rows of one slice for each class of a view."""
    scores = probs[:, present]
    if kind == AUC:
        total = scores.sum(axis=1, keepdims=True)
        scores = np.where(total > 0, scores / np.where(total > 0, total, 1), 1 / len(present))
    # Of two classes the AUC is that of the second.
    for place in range(1 if kind == AUC and len(present) == 2 else 0, len(present)):
        score, mine = scores[:, place] + 0.0, label == present[place]
        good = ~np.isnan(score)
        if good.all():
            yield present[place], score, np.where(mine, mass, 0), np.where(mine, 0, mass)
        elif good.any():
            yield present[place], score[good], np.where(mine, mass, 0)[good], np.where(mine, 0, mass)[good]


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _by_view(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[tuple]:
    """``(view, class, score, hits, misses)`` of as many rows as may be held."""
    for rows in _held(batches, HELD_ROWS):
        one = {name: rows.column(name).combine_chunks() for name in rows.column_names}
        probs = _matrix(one["probs"])
        label, mass, view = (one[name].to_numpy(zero_copy_only=False) for name in ("label", "mass", "view"))
        order = np.argsort(view, kind="stable")
        cuts = np.flatnonzero(np.diff(view[order])) + 1
        for at in np.split(order, cuts):
            first, classes = view[at[0]], [int(k) for k in one["present"][int(at[0])].as_py().split()]
            kinds = [(first, AUC), (first + 1, AP)] if classes else [(first, BOTH)]
            classes, mine = classes or list(range(n_classes)), (probs[at], label[at], mass[at])
            for own, kind in kinds:
                for k, *found in _view_scores(*mine, kind, classes):
                    yield own, k, *found


def _planes(values: np.ndarray) -> bytes:
    """All first bytes before all second ones, and so on, compressed: many of them are 0."""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), codec="zstd", asbytes=True)


def _flat(told: bytes, n: int, size: int) -> np.ndarray:
    plain = pa.decompress(told, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(size, n).T.copy()


def _told(values: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them; the first byte tells how many."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([values.itemsize]) + _planes(values)


def _heard(told: bytes, n: int) -> np.ndarray:
    return _flat(told[1:], n, told[0]).view(f"u{told[0]}").ravel()


def _told_scores(score: np.ndarray) -> bytes:
    """Falling numbers as their count and the steps between them, which are small."""
    bits = score.view(np.int64)
    # Whole numbers in the order of the scores, negative ones too.
    bits = (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.uint64)
    return len(score).to_bytes(8, "little") + _planes(np.concatenate([bits[:1], bits[:-1] - bits[1:]]))


def _heard_scores(told: bytes) -> np.ndarray:
    steps = _flat(told[8:], int.from_bytes(told[:8], "little"), 8).view(np.uint64).ravel()
    bits = (steps[:1] + steps[:1] - np.cumsum(steps, dtype=np.uint64)).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def _falling(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by falling score, equal scores as one."""
    order = np.argsort(-score, kind="stable")
    score, pos, neg = score[order], pos[order], neg[order]
    at = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    if len(at) < len(score):
        score, pos, neg = score[at], np.add.reduceat(pos, at), np.add.reduceat(neg, at)
    return score, pos, neg


def _runs(n_classes: int, bounds: dict[tuple[int, int], np.ndarray]):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for view, k, score, pos, neg in _by_view(batches, n_classes):
            score, pos, neg = _falling(score, pos.astype(np.int64), neg.astype(np.int64))
            # A bound is the lowest score of its bucket.
            ends = np.searchsorted(-score, -bounds.get((view, k), np.empty(0)), side="right")
            for bucket, (low, high) in enumerate(zip([0, *ends], [*ends, len(score)])):
                if low < high:
                    part = score[low:high], pos[low:high], neg[low:high]
                    found.append((view, k, bucket, part[1].sum(), part[2].sum(), _told_scores(part[0]), *map(_told, part[1:])))
            if len(found) >= 64:
                yield _run_batch(found)
                found = []
        if found:
            yield _run_batch(found)

    return made


def _run_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    names = ["view", "k", "bucket", "pos", "neg", "score", "hits", "misses"]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], names=names)


def _merged(metric: str | None):
    def merged(runs: pa.Table) -> pa.Table:
        parts = []
        for told, *counts in zip(*(runs.column(name).to_pylist() for name in ("score", "hits", "misses"))):
            score = _heard_scores(told)
            parts.append([score, *(_heard(x, len(score)) for x in counts)])
        score, pos, neg = (np.concatenate(column) for column in zip(*parts))
        _, pos, neg = _falling(score, pos.astype(np.int64), neg.astype(np.int64))
        above = [runs.column(name)[0].as_py() for name in ("above_pos", "above_neg")]
        won, precise, pos, neg = _area(pos[None, :].astype(float), neg[None, :].astype(float), *above, metric)
        return pa.table(
            {
                "view": pa.array([runs.column("view")[0].as_py()], pa.int64()),
                "k": pa.array([runs.column("k")[0].as_py()], pa.int32()),
                "resample": pa.array([0], pa.int32()),
                **{name: pa.array(x, pa.float64()) for name, x in (("won", won), ("precise", precise), ("pos", pos), ("neg", neg))},
            }
        )

    return merged


def _scores(n_classes: int):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for view, k, score, _, _ in _by_view(batches, n_classes):
            n = len(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, view), pa.int64()), pa.array(np.full(n, k), pa.int32()), pa.array(score, pa.float64())],
                names=["view", "k", "score"],
            )

    return told


def _bounds(rows: DataFrame, n_classes: int, buckets: int) -> dict[tuple[int, int], np.ndarray]:
    """Falling scores that part a class of a large view into buckets, from rows chosen by digest.

    They only place the work: whatever they are, every entry falls in one bucket.
    """
    chosen = rows.filter(F.pmod(F.xxhash64("view", "label", "probs"), F.lit(BUCKET // PLACING)) == 0)
    steps = [1 - (i + 1) / buckets for i in range(buckets - 1)]
    found = chosen.mapInArrow(_scores(n_classes), "view bigint, k int, score double").groupBy("view", "k")
    placed = found.agg(F.percentile_approx("score", steps, 10000).alias("at")).collect()
    return {(row["view"], row["k"]): -np.unique(-np.array(row["at"])) for row in placed}


def exact_areas(rows: DataFrame, n_classes: int, most: int, metric: str | None = None) -> DataFrame:
    """``view, k, auc, ap`` of rows with ``view, present, label, mass, probs``.

    Views are even. ``present`` is empty if all classes are there; else it tells those that are, with blanks
    between (a text, as Spark is slow to send arrays that are null), ``view`` is that of their
    AUC, and the next number that of their average precision. ``most`` is how many rows the largest
    view has. ``metric`` may name the one that is wanted; the other is not worked out.
    """
    buckets = -(-most // BUCKET)
    bounds = _bounds(rows, n_classes, buckets) if buckets > 1 else {}
    runs = durable(rows.mapInArrow(_runs(n_classes, bounds), _RUN), "zstd")
    place, above = ["view", "k", "bucket"], Window.partitionBy("view", "k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each bucket, of which a task makes millions of entries.
    offsets = runs.groupBy(*place).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(
        *place, *[F.coalesce(F.sum(name).over(above), F.lit(0)).alias(f"above_{name}") for name in ("pos", "neg")]
    )
    scored = runs.drop("pos", "neg").join(offsets, place).groupBy(*place).applyInArrow(_merged(metric), _AREAS)
    return _named(scored, metric).drop("resample")


def _named(scored: DataFrame, metric: str | None) -> DataFrame:
    sums = scored.groupBy("view", "k", "resample").agg(*[F.sum(n).alias(n) for n in ("won", "precise", "pos", "neg")])
    auc, ap = F.try_divide("won", F.col("pos") * F.col("neg")), F.try_divide("precise", "pos")
    nothing = F.lit(None).cast("double")
    return sums.select(
        "view",
        "k",
        "resample",
        (nothing if metric == AP_NAME else auc).alias("auc"),
        (nothing if metric == AUC_NAME else ap).alias("ap"),
    )


def view_kinds(present: Column, n_classes: int) -> Column:
    """What a view of these present classes is laid out for.

    Unless all classes are there, the AUC is taken of scores renormalised over those that are,
    and the average precision of the scores as given.
    """
    every = (F.size(present) == n_classes) & (F.size(present) > 2)
    return F.when(every, F.array(F.lit(BOTH))).otherwise(F.array(F.lit(AUC), F.lit(AP)))


def entries(rows: DataFrame) -> DataFrame:
    """``view, k, score, unit, pos, neg`` from ``slice, views, label, unit, mass, probs``.

    ``views`` is the slice's array of ``view, kind, present``, each of two classes or more. What a
    batch repeats is one entry, so a score that many rows share is few entries.
    """
    slim = rows.select("slice", "views", F.col("label").cast("int"), F.col("unit").cast("int"), F.col("mass").cast("bigint"), "probs")
    return slim.mapInArrow(_entries, _ENTRY)


def areas(found: DataFrame, views: DataFrame, draws: Draws, metric: str | None = None) -> DataFrame:
    """``view, k, resample, auc, ap`` of entries.

    ``views`` has ``view, groups, resamples``: how many groups the view's slice has,
    and the sorted numbers of the resamples that are scored by this view. ``metric`` may name the
    one that is wanted; the other is not worked out.
    """
    place = [F.col("view"), F.col("k"), F.desc("score")]
    # Written first: a range partitioning reads its input twice.
    chunks = durable(
        durable(found)
        .repartitionByRange(*place)
        .sortWithinPartitions(*place, "unit")
        .mapInArrow(_pack(False), _CHUNK)
        .withColumn("seq", F.spark_partition_id().cast("bigint") * (1 << 40) + F.col("seq"))
    )
    # A task makes all draws, so there are no more tasks than work at a time or hold what is held at a time.
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() * CHUNK // HELD_ENTRIES))
    chunks = chunks.join(views.select("view", "groups", "resamples"), "view")
    dealt = chunks.repartitionByRange(tasks, "view", "k", "seq")
    sums = durable(dealt.mapInArrow(_sums(draws, metric), _SUMS))
    earlier = Window.partitionBy("view", "k", "resample").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    above = {f"above_{name}": F.coalesce(F.sum(name).over(earlier), F.lit(0.0)) for name in ("pos", "neg")}
    placed, key = sums.withColumns(above), ["view", "k", "resample"]
    won = F.col("won") + F.col("above_pos") * F.col("neg")
    scored = placed.select(*key, won.alias("won"), F.lit(0.0).alias("precise"), "pos", "neg")
    if metric != AUC_NAME:
        # One row a chunk with a vector of sums, as long as there are resamples.
        told = F.struct("resample", F.col("above_pos").alias("pos"), F.col("above_neg").alias("neg"))
        before = placed.groupBy("view", "k", "seq").agg(F.array_sort(F.collect_list(told)).alias("before"))
        precise = chunks.join(before, ["view", "k", "seq"]).mapInArrow(_precisions(draws), _PRECISE)
        none = {name: F.lit(0.0) for name in ("won", "pos", "neg")}
        scored = scored.unionByName(precise.withColumns(none))
    return _named(scored, metric)
