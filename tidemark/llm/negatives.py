"""Hard negatives by inner products, with LEMP's coordinate pruning.

Rows are laid out by label and falling length (norm), range-partitioned by Spark into chunks.
In the task that compares a chunk with a block of anchors, the chunk is cut into buckets of
like length. A bucket has a sorted list of each coordinate of its normalised vectors.
For an anchor and a score that a partner has to reach, the angle between the two is bounded;
so on each of the anchor's ``FOCUS`` largest coordinates a partner's value lies in a feasible
range, which is a run of the sorted list. The shortest run gives the candidates, the
other ranges intersect it, and what is left is verified by the exact product. Where the
ranges hold most of a bucket the bucket is multiplied as a whole. Buckets come in falling
length, so the score to reach rises as results come in, and buckets that are too short are
not looked at.

1. Positives: an anchor meets the chunks of its own label only.
2. Negatives: with the positives' scores known, an anchor meets those chunks with other
   labels whose longest row can reach the least score wanted. A chunk is copied once for each
   block of ``BLOCK`` anchors that asks for it.

Scores are products of whole numbers and exact: in doubles where these hold them, else in
64-bit integers. A component that is no number below 2**20 in size fails the job, since
its scores could leave a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import durable

#: Rows of a chunk and of a bucket, anchors of a block and of one multiplication.
CHUNK, LEAST_CHUNKS, BUCKET, BLOCK, SLICE = 1 << 16, 24, 2048, 8192, 64
#: Rows of a bucket are at least this share of its longest row in length.
ALIKE = 0.9
FOCUS = 3
#: Ranges that leave more than this share of a bucket are not worth intersecting.
DENSE = 0.5
SCALE, LARGEST = 256, 1 << 20


def whole_vector(vector: Column) -> Column:
    """Each component ``x`` as ``floor(256 * x)``, ``x`` as a double."""
    told = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) >= LARGEST)
    return F.when(large, F.raise_error(F.lit("a component of 2**20 or more")).cast("array<bigint>")).otherwise(told)


class Bucket:
    """Rows of like length with their normalised coordinates; sorted lists are made when asked for."""

    def __init__(self, exact: np.ndarray, lengths: np.ndarray, at: np.ndarray):
        self.exact, self.at = exact, at
        self.longest, self.shortest = lengths[0], lengths[-1]
        self.unit = exact / np.maximum(lengths, 1e-300)[:, None] if self.shortest > 0 else None
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, axis: int) -> tuple[np.ndarray, np.ndarray]:
        if axis not in self._lists:
            order = np.argsort(self.unit[:, axis], kind="stable")
            self._lists[axis] = (self.unit[order, axis], order)
        return self._lists[axis]

    def angle(self, needed: float, length: float) -> float:
        """The cosine that a row needs for the score ``needed``; over 1: no row can have it."""
        if needed == -inf:
            return -1.0
        if self.unit is None or length == 0:
            # Zero vectors: every score is 0.
            return -1.0 if needed <= 0 else inf
        return needed / (length * (self.longest if needed > 0 else self.shortest)) - 1e-9

    def feasible(self, anchor: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows within the feasible ranges of the focus coordinates; None: too many to list.

        ``anchor`` is a unit vector. If two unit vectors are at most the angle d apart, their
        values on an axis, as cosines of angles to that axis, are at most d apart too.
        """
        if self.unit is None or cosine <= -1:
            return None
        focus = np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]
        spread, here = np.arccos(min(cosine, 1.0)), np.arccos(np.clip(anchor[focus], -1, 1))
        low = np.cos(np.minimum(here + spread, np.pi)) - 1e-9
        high = np.cos(np.maximum(here - spread, 0.0)) + 1e-9
        runs = []
        for axis, lo, hi in zip(focus, low, high):
            values, order = self.sorted_list(int(axis))
            first, last = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
            runs.append((last - first, order[first:last], axis))
        size, rows, own = min(runs, key=lambda run: run[0])
        if size > DENSE * len(self.at):
            return None
        for axis, lo, hi in zip(focus, low, high):
            if axis != own:
                value = self.unit[rows, axis]
                rows = rows[(value >= lo) & (value <= hi)]
        return np.sort(rows)


def buckets(exact: np.ndarray) -> Iterator[Bucket]:
    """Rows by falling length, cut where a bucket is full or a row is much shorter."""
    lengths = np.sqrt((exact.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    lengths, start = lengths[order], 0
    while start < len(order):
        end = start + int(np.searchsorted(-lengths[start:], -ALIKE * lengths[start], side="right"))
        end = min(max(end, start + 1), start + BUCKET)
        yield Bucket(exact[order[start:end]], lengths[start:end], order[start:end])
        start = end


class Best:
    """The first ``keep`` of a score range, by falling score and then by id and place."""

    def __init__(self, low: float, high: float, keep: int):
        self.low, self.high, self.keep = low, high, keep
        self.scores, self.ids, self.at = (np.zeros(0, np.int64) for _ in range(3))

    @property
    def needed(self) -> float:
        return max(self.low, float(self.scores[-1])) if len(self.scores) == self.keep else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        fits = (scores >= self.needed) & (scores <= self.high)
        if not fits.any():
            return
        scores, ids, at = scores[fits], ids[fits], at[fits]
        if len(scores) > self.keep:
            # All that tie with the last place stay in.
            edge = np.partition(scores, len(scores) - self.keep)[len(scores) - self.keep]
            ids, at, scores = ids[scores >= edge], at[scores >= edge], scores[scores >= edge]
        scores, ids, at = (np.concatenate(pair) for pair in ((self.scores, scores), (self.ids, ids), (self.at, at)))
        order = np.lexsort([at, ids, -scores])[: self.keep]
        self.scores, self.ids, self.at = scores[order], ids[order], at[order]


def search(
    rows: np.ndarray,
    ids: np.ndarray,
    marks: np.ndarray,
    anchors: np.ndarray,
    allowed: Callable[[int], np.ndarray],
    wanted: list[list[Best]],
) -> None:
    """Offer every row of the chunk to the score ranges of every anchor, pruned as described.

    ``allowed(i)`` tells which rows anchor ``i`` may take.
    """
    largest = float(np.abs(rows).max(initial=1)) * float(np.abs(anchors).max(initial=1)) * rows.shape[1]
    kind = np.float64 if largest < 2**53 else np.int64
    exact, asked = rows.astype(kind), anchors.astype(kind)
    lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    unit = anchors / np.maximum(lengths, 1e-300)[:, None]
    masks = [allowed(i) for i in range(len(anchors))] if len(anchors) else []
    for bucket in buckets(exact):
        dense = []
        for i, ranges in enumerate(wanted):
            cosine = bucket.angle(min(r.needed for r in ranges), lengths[i])
            if cosine > 1:
                continue
            near = bucket.feasible(unit[i], cosine)
            if near is None:
                dense.append(i)
            else:
                _verify(bucket, near, asked[i], ids, marks, masks[i], ranges)
        for low in range(0, len(dense), SLICE):
            some = dense[low : low + SLICE]
            scores = asked[some] @ bucket.exact.T
            for i, row in zip(some, scores):
                _offer(row, bucket.at, ids, marks, masks[i], wanted[i])


def _verify(bucket: Bucket, near: np.ndarray, anchor, ids, marks, mask, ranges: list[Best]) -> None:
    if len(near):
        _offer(bucket.exact[near] @ anchor, bucket.at[near], ids, marks, mask, ranges)


def _offer(scores: np.ndarray, at: np.ndarray, ids, marks, mask, ranges: list[Best]) -> None:
    take = mask[at] & (scores >= min(r.needed for r in ranges))
    at, scores = at[take], scores[take].astype(np.int64)
    for best in ranges:
        best.offer(scores, ids[at], marks[at])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _told(schema: dict[str, type], parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    columns = list(zip(*parts)) if parts else [()] * len(schema)
    return pa.table({n: np.concatenate([np.zeros(0, k), *c]).astype(k) for (n, k), c in zip(schema.items(), columns)})


def _positives(keep: int):
    def compared(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        kinds, out = {"anchor": np.int64, "mark": np.int64, "positive_id": np.int64, "positive_score": np.int64}, []
        if rows.num_rows and anchors.num_rows:
            ids, marks, labels = (_numbers(rows, name) for name in ("vec_id", "mark", "label"))
            own, label = _numbers(anchors, "mark"), _numbers(anchors, "label")
            wanted = [[Best(-inf, inf, keep)] for _ in own]

            def alike(i: int) -> np.ndarray:
                return (labels == label[i]) & (marks != own[i])

            search(_matrix(rows.column("vector")), ids, marks, _matrix(anchors.column("vector")), alike, wanted)
            for mark, (best,) in zip(own, wanted):
                out.append((np.full(len(best.at), mark), best.at, best.ids, best.scores))
        return _told(kinds, out)

    return compared


def _negatives(keep: int):
    def compared(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        kinds = {"anchor": np.int64, "low": np.int64, "high": np.int64, "mark": np.int64, "negative_id": np.int64, "negative_score": np.int64}
        out = []
        if rows.num_rows and anchors.num_rows:
            ids, marks, labels = (_numbers(rows, name) for name in ("vec_id", "mark", "label"))
            own, label = _numbers(anchors, "mark"), _numbers(anchors, "label")
            asked = [[(r["low"], r["high"]) for r in ranges] for ranges in anchors.column("ranges").to_pylist()]
            wanted = [[Best(low, high, keep) for low, high in ranges] for ranges in asked]
            search(_matrix(rows.column("vector")), ids, marks, _matrix(anchors.column("vector")), lambda i: labels != label[i], wanted)
            for mark, ranges, found in zip(own, asked, wanted):
                for (low, high), best in zip(ranges, found):
                    n = len(best.at)
                    out.append((np.full(n, mark), np.full(n, low), np.full(n, high), best.at, best.ids, best.scores))
        return _told(kinds, out)

    return compared


def _compared(rows: DataFrame, asks: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over each pair of a chunk and a block of anchors that ask for it."""
    group = ["chunk", "width", "block"]
    asks = asks.toDF(*asks.columns)
    pairs = asks.select(*group).distinct()
    copied = rows.join(pairs, ["chunk", "width"])
    copied = copied.toDF(*copied.columns)
    return copied.groupBy(*group).cogroup(asks.groupBy(*group)).applyInArrow(function, schema)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vectors``. An anchor's positives are the first rows of its
    label; for each, the first rows of other labels whose score is ``least`` to ``most``
    percent of the positive's are returned. Higher scores come first, ties by smaller id.

    Rows take no part if id, label or vector is null, if the vector is empty, or if a component
    is null or non-finite. Rows that repeat id, label and vector are one row; other rows that
    share an id stay apart. Only vectors of the same length are compared. Labels are whole numbers.
    """
    whole = F.col("vector")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size(whole) > 0)
        & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    )
    given = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label_col}`").cast("bigint").alias("label"),
        F.col(f"`{vector_col}`").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter(sound)
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    points = durable(
        given.groupBy("vec_id", "label", "vector")
        .agg(F.max("asks").alias("asks"))
        .withColumn("vector", whole_vector(whole))
        .withColumn("width", F.size("vector"))
        .withColumn("length", F.sqrt(square))
        .withColumn("mark", F.monotonically_increasing_id())
    )
    chunks = max(LEAST_CHUNKS, ceil(points.count() / CHUNK))
    laid = durable(
        points.repartitionByRange(chunks, "width", "label", F.desc("length"), F.xxhash64("mark"))
        .withColumn("chunk", F.spark_partition_id())
    )
    rows = laid.select("chunk", "width", "label", "vec_id", "mark", "vector")
    anchors = laid.filter("asks").select("width", "label", "vec_id", "mark", "vector", "length")
    # Chunks and labels: one row for each label that a chunk holds.
    held = durable(laid.groupBy("chunk", "width", "label").agg(F.max("length").alias("longest")))
    blocks = ceil(anchors.count() / BLOCK) or 1
    block = F.pmod(F.xxhash64("mark"), F.lit(blocks)).alias("block")

    asks = anchors.join(held.select("chunk", "width", "label"), ["width", "label"])
    asks = asks.select("chunk", "width", block, "mark", "label", "vector")
    found = _compared(rows, asks, _positives(positives), "anchor bigint, mark bigint, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "mark")
    chosen = durable(found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives))

    # Whole numbers within the percentages: rounded inwards.
    low = F.expr(f"(positive_score * {least} + pmod(-positive_score * {least}, 100)) div 100")
    high = F.expr(f"(positive_score * {most} - pmod(positive_score * {most}, 100)) div 100")
    ranged = chosen.select("anchor", "place", "positive_id", "positive_score", low.alias("low"), high.alias("high")).filter("low <= high")
    wanted = ranged.groupBy("anchor").agg(F.collect_set(F.struct("low", "high")).alias("ranges"), F.min("low").alias("least"))
    ready = anchors.join(wanted, F.col("mark") == F.col("anchor"))
    # A chunk in which every row has the anchor's label, or is too short, is not asked.
    parts = held.groupBy("chunk", "width").agg(
        F.max("longest").alias("longest"), F.min("label").alias("first_label"), F.max("label").alias("last_label")
    )
    other = (F.col("first_label") != F.col("label")) | (F.col("last_label") != F.col("label"))
    reached = (F.col("least") <= 0) | (F.col("longest") * F.col("length") * 1.000001 >= F.col("least"))
    asks = ready.join(parts, "width").filter(other & reached).select("chunk", "width", block, "mark", "label", "vector", "ranges")
    schema = "anchor bigint, low bigint, high bigint, mark bigint, negative_id bigint, negative_score bigint"
    met = _compared(rows, asks, _negatives(negatives), schema)
    nearest = Window.partitionBy("anchor", "low", "high").orderBy(F.desc("negative_score"), "negative_id", "mark")
    kept = met.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= negatives)
    names = anchors.select(F.col("mark").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        ranged.join(kept.drop("mark"), ["anchor", "low", "high"])
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            "positive_score",
            "negative_score",
        )
    )
