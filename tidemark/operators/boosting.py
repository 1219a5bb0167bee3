"""Gradient-boosted trees of all splits and classes at once, by histograms.

Features are cut into bins once. A round grows one tree for each split and class; all their
levels are grown together: a scan adds up gradients and hessians by (model, node, feature,
bin), which is all the driver sees, and the driver picks the splits. Windows walk the round's
trees and those since the last writing in the task; every ``KEPT`` rounds their margins are
written, so that a scan never walks more trees than that. A split's validation loss comes
with the next round's first scan, and splits that stopped improving leave the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import durable
from tidemark.operators.probes import PARTS, TRAIN, VALIDATION, batch_matrix, scan_batches, softmax

KEPT = 10


@dataclass(frozen=True)
class Settings:
    """What a booster is grown by; the defaults are those of the models that are compared here."""

    rounds: int = 800
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    least_weight: float = 2.0
    penalty: float = 1.0
    patience: int = 60
    bins: int = 64
    seed: int = 1234


@dataclass
class Tree:
    """Nodes in order of depth: children of node i are 2i + 1 and 2i + 2; a leaf has no feature."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def nodes(self, binned: np.ndarray, depth: int) -> np.ndarray:
        """The node at ``depth`` or the leaf above it that each row of bins falls into."""
        at = np.zeros(len(binned), dtype=np.int64)
        for _ in range(depth):
            feature = self.feature[at]
            go = feature >= 0
            right = binned[np.arange(len(binned)), np.maximum(feature, 0)] > self.edge[at]
            at = np.where(go, 2 * at + 1 + right, at)
        return at


def bin_edges(windows: DataFrame, bins: int) -> list[np.ndarray]:
    """Cut points of every feature: quantiles of all windows, so that no label is looked at."""
    width = len(windows.select("features").head()["features"])
    shares = [i / bins for i in range(1, bins)]
    told = windows.agg(*[F.percentile_approx(F.col("features")[j], shares, 10000).alias(f"f{j}") for j in range(width)]).head()
    return [np.unique(np.array(told[f"f{j}"], dtype=float)) for j in range(width)]


def kept_rows(mark: np.ndarray, number: int, model: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees: a digest of row, round and model, alike in every run of a task."""
    x = mark.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xBF58476D1CE4E5B9 + model) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(float) / 2**24 < share


def best_splits(grad: np.ndarray, hess: np.ndarray, allowed: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """Gain, feature and edge of every node from sums of shape (nodes, features, bins)."""
    left_g, left_h = grad.cumsum(axis=2)[:, :, :-1], hess.cumsum(axis=2)[:, :, :-1]
    all_g, all_h = grad.sum(axis=2, keepdims=True), hess.sum(axis=2, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    score = lambda g, h: g * g / (h + settings.penalty)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
    sound = (left_h >= settings.least_weight) & (right_h >= settings.least_weight) & allowed[None, :, None]
    gain = np.where(sound, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), best], best // gain.shape[2], best % gain.shape[2]


def slopes(margins: np.ndarray, label: np.ndarray, weight: np.ndarray, n_classes: int) -> tuple[np.ndarray, ...]:
    """Gradients, hessians and loss of each row from its margins in one split."""
    if n_classes == 2:
        p = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
        hit = label[:, None] == 1
        loss = -np.log(np.maximum(np.where(hit, p, 1 - p), 1e-300))[:, 0]
        return weight[:, None] * (p - hit), weight[:, None] * p * (1 - p), loss
    p = softmax(margins)
    hit = label[:, None] == np.arange(n_classes)
    return weight[:, None] * (p - hit), 2 * weight[:, None] * p * (1 - p), -np.log(np.maximum(p[hit], 1e-300))


class Booster:
    """Grows the trees of ``models``, which are pairs of a split and a class."""

    def __init__(self, windows: DataFrame, n_splits: int, n_classes: int, settings: Settings):
        self.s, self.n_splits, self.n_classes = settings, n_splits, n_classes
        # Two classes need one margin, more have one each and a softmax over them.
        self.per = 1 if n_classes == 2 else n_classes
        self.edges = bin_edges(windows, settings.bins)
        self.width, self.bins = len(self.edges), max(len(e) for e in self.edges) + 1
        edges = self.edges

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch_matrix(batch, "features")
                cut = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
                lists = _lists(cut.astype(np.int16), pa.int16())
                margins = _lists(np.zeros((len(x), n_splits * self.per)), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column(PARTS), batch.column("mark"), lists, margins], names=names
                )

        names = ["label", PARTS, "mark", "bins", "margins"]
        self.schema = f"label int, {PARTS} array<tinyint>, mark bigint, bins array<smallint>, margins array<double>"
        slim = windows.select(F.col("label").cast("int"), PARTS, F.xxhash64("item_id", "window_index").alias("mark"), "features")
        self.state = durable(slim.mapInArrow(binned, self.schema))
        counts = self.state.groupBy("label").agg(
            *[F.count_if(F.col(PARTS)[s] == TRAIN).alias(f"s{s}") for s in range(n_splits)]
        ).collect()
        held = np.zeros((n_splits, n_classes))
        for row in counts:
            held[:, row["label"]] = [row[f"s{s}"] for s in range(n_splits)]
        self.weights = np.where(held > 0, held.sum(axis=1, keepdims=True) / (n_classes * np.maximum(held, 1)), 0.0)
        self.trees: list[dict[tuple[int, int], Tree]] = []
        self.written = 0
        self.kept = np.zeros(n_splits, dtype=int)

    def fit(self) -> "Booster":
        lowest, since = np.full(self.n_splits, np.inf), np.zeros(self.n_splits, dtype=int)
        active, number = list(range(self.n_splits)), 0
        while active:
            models = [(s, k) for s in active for k in range(self.per)]
            grown, losses = self._round(models, number)
            for split, loss in zip(active, losses):
                better = loss < lowest[split]
                if better:
                    lowest[split], self.kept[split] = loss, number
                since[split] = 0 if better else since[split] + 1
            active = [s for s in active if since[s] < self.s.patience and number < self.s.rounds]
            self.trees.append({m: t for m, t in grown.items() if m[0] in active})
            number += 1
            if len(self.trees) - self.written >= KEPT:
                self._write()
        return self

    def _pending(self) -> list[dict[tuple[int, int], Tree]]:
        return self.trees[self.written :]

    def _write(self) -> None:
        pending, add = self._pending(), self._margins()

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = add(batch, pending)
                at = batch.schema.get_field_index("margins")
                yield batch.set_column(at, "margins", _lists(margins, pa.float64()))

        self.state, self.written = durable(self.state.mapInArrow(moved, self.schema)), len(self.trees)

    def _margins(self):
        per, depth = self.per, self.s.depth

        def add(batch: pa.RecordBatch, rounds: Sequence[dict[tuple[int, int], Tree]]) -> np.ndarray:
            margins, binned = batch_matrix(batch, "margins"), batch_matrix(batch, "bins").astype(np.int64)
            for trees in rounds:
                for (split, k), tree in trees.items():
                    margins[:, split * per + k] += tree.value[tree.nodes(binned, depth)]
            return margins

        return add

    def _round(self, models: list[tuple[int, int]], number: int) -> tuple[dict[tuple[int, int], Tree], list[float]]:
        """A tree for each model, and each split's validation loss before it."""
        size, s = 2 ** (self.s.depth + 1) - 1, self.s
        trees = {m: Tree(np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size), np.zeros(self.width)) for m in models}
        draw, losses = np.random.default_rng([s.seed, number]), []
        count = max(1, round(s.columns * self.width))
        columns = {m: np.isin(np.arange(self.width), draw.permutation(self.width)[:count]) for m in models}
        for level in range(s.depth):
            hist, told = self._histograms(models, trees, number, level)
            if level == 0:
                losses = told
            first, split_any = 2**level - 1, False
            for m, (grad, hess) in zip(models, hist):
                tree, total = trees[m], (grad[:, 0].sum(axis=1), hess[:, 0].sum(axis=1))
                tree.value[first : 2 * first + 1] = np.where(
                    total[1] > 0, -s.rate * total[0] / (total[1] + s.penalty), tree.value[first : 2 * first + 1]
                )
                gain, feature, edge = best_splits(grad, hess, columns[m], s)
                for node in np.flatnonzero(gain > 1e-12):
                    at, f, e = first + node, feature[node], edge[node]
                    tree.feature[at], tree.edge[at], split_any = f, e, True
                    tree.gain[f] += gain[node]
                    left = grad[node, f, : e + 1].sum(), hess[node, f, : e + 1].sum()
                    for child, (g, h) in ((2 * at + 1, left), (2 * at + 2, (total[0][node] - left[0], total[1][node] - left[1]))):
                        tree.value[child] = -s.rate * g / (h + s.penalty)
            if not split_any:
                break
        return trees, losses

    def _histograms(self, models, trees, number: int, level: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float]]:
        nodes, width, bins, s = 2**level, self.width, self.bins, self.s
        pending, add, per, n_classes, weights = self._pending(), self._margins(), self.per, self.n_classes, self.weights
        splits = sorted({split for split, _ in models})
        cell, first = nodes * width * bins, 2**level - 1

        def terms(batch: pa.RecordBatch) -> np.ndarray:
            margins, parts = add(batch, pending), batch_matrix(batch, PARTS).astype(np.int8)
            label, mark = batch.column("label").to_numpy().astype(int), batch.column("mark").to_numpy()
            binned, at = batch_matrix(batch, "bins").astype(np.int64), 0
            whole = np.zeros(2 * cell * len(models) + 2 * len(splits))
            for split in splits:
                own_margins = margins[:, split * per : (split + 1) * per]
                grad, hess, loss = slopes(own_margins, label, weights[split][label], n_classes)
                if level == 0:
                    held = parts[:, split] == VALIDATION
                    place = 2 * cell * len(models) + 2 * splits.index(split)
                    whole[place : place + 2] = loss[held].sum(), held.sum()
                for k in [k for own, k in models if own == split]:
                    tree = trees[split, k]
                    own = (parts[:, split] == TRAIN) & kept_rows(mark, number, split * 1009 + k, s.rows, s.seed)
                    node = tree.nodes(binned[own], level) - first
                    # Rows that stopped at a leaf above this level have no node here.
                    there = node >= 0
                    rows = np.flatnonzero(own)[there]
                    code = (node[there][:, None] * width + np.arange(width)) * bins + binned[rows]
                    for values in (grad, hess):
                        whole[at : at + cell] = np.bincount(code.ravel(), np.repeat(values[rows, k], width), cell)
                        at += cell
            return whole

        told = scan_batches(self.state, terms, 2 * cell * len(models) + 2 * len(splits))
        sums = told[: 2 * cell * len(models)].reshape(len(models), 2, nodes, width, bins)
        held = told[2 * cell * len(models) :].reshape(-1, 2)
        return [(m[0], m[1]) for m in sums], (held[:, 0] / np.maximum(held[:, 1], 1)).tolist()

    def probs(self, x: np.ndarray, split: int) -> np.ndarray:
        """Class probabilities of raw features by the trees that a split keeps."""
        cut = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        margins = np.zeros((len(x), self.per))
        for trees in self.trees[: self.kept[split]]:
            for k in range(self.per):
                tree = trees[split, k]
                margins[:, k] += tree.value[tree.nodes(cut, self.s.depth)]
        if self.per > 1:
            return softmax(margins)
        p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -500, 500)))
        return np.stack([1 - p, p], axis=1)

    def gains(self, split: int) -> np.ndarray:
        """What each feature's cuts have gained in the trees that a split keeps."""
        kept = [tree.gain for trees in self.trees[: self.kept[split]] for m, tree in trees.items() if m[0] == split]
        return np.sum(kept, axis=0) if kept else np.zeros(self.width)

    def predictor(self):
        """A small object to send to tasks: everything but the windows."""
        light = object.__new__(Booster)
        light.__dict__ = {name: value for name, value in self.__dict__.items() if name not in ("state", "schema")}
        return light


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(matrix.ravel(), kind))
