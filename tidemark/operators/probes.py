"""Linear softmax probes of all splits and penalties at once.

Every model is a block of columns of one coefficient matrix. A step of the descent is one
scan of the windows: each batch is multiplied with all coefficients together, a window counts
for those splits in which its item trains, and only sums as large as the models are shuffled.
The driver holds coefficients and nothing that grows with the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = "__parts"
TRAIN, VALIDATION, TEST = 1, 2, 3
#: Iterations between which the gradient's history is kept, and halvings of a step.
HISTORY, HALVINGS = 8, 20


def batch_matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def scan_batches(rows: DataFrame, terms: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """``terms(batch)`` summed over all batches of ``rows``.

    Partitions sum their batches; the sums of partitions meet place by place.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += terms(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "value"])

    whole = np.zeros(size)
    for row in rows.mapInArrow(summed, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        whole[row["at"]] = row["value"]
    return whole


def scan_sums(windows: DataFrame, terms: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """``terms(features, labels, parts)`` of each batch summed over all windows."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        return terms(batch_matrix(batch, "features"), label, batch_matrix(batch, PARTS).astype(np.int8))

    return scan_batches(windows.select("features", "label", PARTS), of, size)


class Moments:
    """Per split: training windows of each class, and centre and scale of each feature."""

    def __init__(self, windows: DataFrame, n_splits: int, n_classes: int):
        first = windows.select("features").head()
        # Sums are taken from a point among the data, so that large offsets cancel first.
        self.origin = np.array(first["features"], dtype=float)
        width, origin = len(self.origin), self.origin
        n_parts = (n_classes, width, width)

        def terms(x, label, parts):
            x, training = x - origin, (parts == TRAIN).astype(float)
            classes = np.zeros((len(x), n_classes))
            classes[np.arange(len(x)), label] = 1.0
            return np.concatenate([training.T @ classes, training.T @ x, training.T @ (x * x)], axis=1).ravel()

        told = scan_sums(windows, terms, n_splits * sum(n_parts)).reshape(n_splits, -1)
        self.counts, sums, squares = np.split(told, np.cumsum(n_parts)[:-1], axis=1)
        self.n = self.counts.sum(axis=1)
        n = np.maximum(self.n, 1)[:, None]
        self.centre = sums / n
        spread = np.maximum(squares / n - self.centre**2, 0) * n / np.maximum(n - 1, 1)
        # A constant column scales to 0; what rounding leaves of it is no spread.
        still = spread <= 1e-18 * np.maximum(squares / n, 1e-300)
        self.inverse = np.where(still, 0.0, 1 / np.sqrt(np.where(still, 1.0, spread)))
        # n / (classes * count): a class with no window weighs 0.
        self.weights = np.where(self.counts > 0, self.n[:, None] / (n_classes * np.maximum(self.counts, 1)), 0.0)


class Descent:
    """One model's limited-memory descent, fed with values and gradients from outside."""

    def __init__(self, size: int, max_iter: int, tolerance: float):
        self.at, self.trial = np.zeros(size), np.zeros(size)
        self.value = self.gradient = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.left, self.halvings, self.tolerance, self.done = max_iter, 0, tolerance, False

    def take(self, value: float, gradient: np.ndarray) -> None:
        """The value at ``trial``: accept the step and set out anew, or halve it."""
        if self.value is not None:
            slope = self.gradient @ self.step
            if not value <= self.value + 1e-4 * slope and self.halvings < HALVINGS:
                self.halvings, self.step = self.halvings + 1, self.step / 2
                self.trial = self.at + self.step
                return
            if not value <= self.value:
                self.done = True
                return
            change, turn = self.trial - self.at, gradient - self.gradient
            if change @ turn > 1e-12 * (turn @ turn):
                self.pairs = [*self.pairs, (change, turn)][-HISTORY:]
            small = abs(self.value - value) <= self.tolerance * max(1.0, abs(value))
            self.left -= 1
            self.done = small or self.left <= 0
        self.at, self.value, self.gradient, self.halvings = self.trial, value, gradient, 0
        if np.abs(gradient).max() <= self.tolerance:
            self.done = True
        if not self.done:
            self.step = self._direction()
            self.trial = self.at + self.step

    def _direction(self) -> np.ndarray:
        down, told = -self.gradient, []
        for change, turn in reversed(self.pairs):
            share = (change @ down) / (change @ turn)
            told.append(share)
            down = down - share * turn
        if self.pairs:
            change, turn = self.pairs[-1]
            down = down * (change @ turn) / (turn @ turn)
        else:
            down = down / max(1.0, np.linalg.norm(self.gradient))
        for (change, turn), share in zip(self.pairs, reversed(told)):
            down = down + change * (share - (turn @ down) / (change @ turn))
        return down


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def fit_probes(
    windows: DataFrame, n_splits: int, n_classes: int, penalties: Sequence[float], max_iter: int, tolerance: float = 1e-6
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients ``(splits, width, classes)`` and intercepts ``(splits, classes)`` on raw features.

    ``windows`` has ``features``, ``label`` and ``PARTS``, the part of the item in each split.
    Each model minimises its weighted mean cross entropy plus half the penalty times the squared
    coefficients of standardised features; of several penalties each split takes the one with
    the best macro-F1 on its validation windows, the first of equal ones.
    """
    seen = Moments(windows, n_splits, n_classes)
    width, origin = len(seen.origin), seen.origin
    models = [(s, p) for s in range(n_splits) for p in penalties]
    runs = [Descent((width + 1) * n_classes, max_iter, tolerance) for _ in models]

    def raw(model: int, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = models[model][0]
        table = flat.reshape(width + 1, n_classes)
        scaled = table[:-1] * seen.inverse[split][:, None]
        return scaled, table[-1] - seen.centre[split] @ scaled

    while active := [m for m, run in enumerate(runs) if not run.done]:
        told = [raw(m, runs[m].trial) for m in active]
        matrix, offset = np.concatenate([t[0] for t in told], axis=1), np.concatenate([t[1] for t in told])
        splits, weights = np.array([models[m][0] for m in active]), seen.weights
        n_active, per = len(active), 1 + n_classes * (width + 1)

        def terms(x, label, parts):
            x = x - origin
            probs = softmax((x @ matrix + offset).reshape(len(x), n_active, n_classes))
            weight = weights[splits][:, label].T * (parts[:, splits] == TRAIN)
            own = probs[np.arange(len(x)), :, label]
            loss = -(weight * np.log(np.maximum(own, 1e-300))).sum(axis=0)
            probs[np.arange(len(x)), :, label] -= 1.0
            left = (probs * weight[:, :, None]).reshape(len(x), -1)
            slopes = (x.T @ left).reshape(width, n_active, n_classes)
            whole = np.concatenate([slopes, left.sum(axis=0).reshape(1, n_active, n_classes)])
            return np.concatenate([loss[:, None], whole.transpose(1, 0, 2).reshape(n_active, -1)], axis=1).ravel()

        found = scan_sums(windows, terms, n_active * per).reshape(n_active, per)
        for row, m in zip(found, active):
            split, penalty = models[m]
            mass = max((seen.counts[split] * weights[split]).sum(), 1e-300)
            slopes = row[1:].reshape(width + 1, n_classes) / mass
            slopes[:-1] = (slopes[:-1] - np.outer(seen.centre[split], slopes[-1])) * seen.inverse[split][:, None]
            table = runs[m].trial.reshape(width + 1, n_classes)
            slopes[:-1] += penalty * table[:-1]
            runs[m].take(row[0] / mass + penalty / 2 * (table[:-1] ** 2).sum(), slopes.ravel())

    told = [raw(m, run.at) for m, run in enumerate(runs)]
    matrix = np.stack([t[0] for t in told])
    offset = np.stack([t[1] for t in told]) - origin @ matrix
    best = np.arange(n_splits) * len(penalties)
    if len(penalties) > 1:
        scores = _validation_scores(windows, matrix, offset, [s for s, _ in models], n_classes)
        best = best + scores.reshape(n_splits, -1).argmax(axis=1)
    return matrix[best], offset[best]


def _validation_scores(windows: DataFrame, matrix, offset, splits: list[int], n_classes: int) -> np.ndarray:
    """Macro-F1 of every model on the validation windows of its split."""

    def terms(x, label, parts):
        counts = np.zeros((len(splits), n_classes, n_classes))
        for m, split in enumerate(splits):
            held = parts[:, split] == VALIDATION
            np.add.at(counts[m], (label[held], (x[held] @ matrix[m] + offset[m]).argmax(axis=1)), 1.0)
        return counts.ravel()

    counts = scan_sums(windows, terms, len(splits) * n_classes**2).reshape(-1, n_classes, n_classes)
    seen = counts.sum(axis=1) + counts.sum(axis=2)
    hit = np.einsum("mkk->mk", counts)
    return (2 * hit / np.maximum(seen, 1)).mean(axis=1)


def with_probs(df: DataFrame, matrix: np.ndarray, offset: np.ndarray, split: str | None = None) -> DataFrame:
    """Add ``probs`` by the linear model of the split that the column ``split`` numbers (else the first)."""
    return scored_rows(df, lambda x, one: softmax(x @ matrix[one] + offset[one]), offset.shape[1], split)


def scored_rows(
    df: DataFrame, probs_of: Callable[[np.ndarray, int], np.ndarray], n_classes: int, split: str | None = None
) -> DataFrame:
    """Add ``probs`` by ``probs_of(features, number of the split)``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probs = np.zeros((batch.num_rows, n_classes))
            if batch.num_rows:
                x = batch_matrix(batch, "features")
                own = batch.column(split).to_numpy() if split else np.zeros(batch.num_rows, dtype=int)
                for one in np.unique(own):
                    probs[own == one] = probs_of(x[own == one], int(one))
            ends = pa.array(np.arange(len(probs) + 1, dtype=np.int32) * probs.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(probs.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "probs"])

    return df.mapInArrow(scored, T.StructType([*df.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))]))
