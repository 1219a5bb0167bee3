"""Nearest neighbours by several shifted Hilbert orderings.

Each ordering projects the unit vectors on ``AXES`` random orthonormal directions, shifts
them by a random offset, cuts every axis into a grid and numbers the grid's cells along a
Hilbert curve. Spark range-partitions all vectors by ordering and key, which gives
cells of about ``CELL_ROWS`` vectors in curve order. A query looks through its own cell and
those around it in every ordering; the candidates of all orderings are merged and
ranked by the cosine of the original vectors in double precision.

The window is ``reach``, a share of the curve, so recall is alike at every size. Vectors
without structure (all directions alike) have no order that brings neighbours together:
there the windows have to cover a good part of the rows. Clustered vectors can do with
far less.

Equal vectors are one point of the index with their ``k + 1`` smallest ids: no query can
need more of them. Rows without an id, and vectors that are null, empty, zero, hold a null
or a non-finite number, or have another length than the commonest one (the larger of
equally common ones) take no part, neither as queries nor as candidates. Repeated rows
count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import durable

ORDERINGS, AXES, LEVELS = 16, 8, 7
CELL_ROWS, LEAST_CELLS = 2048, 48
REACH = 0.1
#: Rows of a window at least: small tables, and vectors that tie by hundreds, are seen whole.
LEAST_WINDOW = 1024
#: Queries of a block meet the rows of a cell in one task.
BLOCK = 4096
#: Vectors that the projections' centre and spread are taken from, at most.
SAMPLE = 5000


def hilbert_keys(grid: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row's grid cell on the Hilbert curve (``axes * levels`` bits at most 63).

    The grid is turned into the curve's transposed index by undoing, from the coarsest
    level down, the exchanges and inversions of each sub-cube, and Gray decoding the rest.
    """
    x = grid.T.astype(np.uint64).copy()
    axes, one = len(x), np.uint64(1)
    for level in range(levels - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for axis in range(axes):
            up = (x[axis] & bit) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(up, low, swap)
            x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(levels - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(levels - 1, -1, -1):
        for axis in range(axes):
            key = (key << one) | ((x[axis] >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Orderings:
    """Projections, shifts and grids of all orderings, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, count: int, seed: int):
        draw = np.random.default_rng(seed)
        width = sample.shape[1]
        axes = min(AXES, width)
        self.turns = np.stack([np.linalg.qr(draw.normal(size=(width, axes)))[0] for _ in range(count)])
        seen = np.einsum("nw,owa->ona", _unit(sample), self.turns)
        self.centre = seen.mean(axis=1)
        self.spread = np.maximum(seen.std(axis=1), 1e-12)
        self.shift = draw.uniform(-0.15, 0.15, size=(count, axes))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """The key of each vector (rows) in each ordering (columns)."""
        unit, side = _unit(vectors), 1 << LEVELS
        keys = []
        for turn, centre, spread, shift in zip(self.turns, self.centre, self.spread, self.shift):
            place = (unit @ turn - centre) / (8 * spread) + 0.5 + shift
            keys.append(hilbert_keys(np.clip((place * side).astype(np.int64), 0, side - 1), LEVELS))
        return np.stack(keys, axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither very large nor very small numbers leave the range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists of numbers as the rows of a matrix of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1)


def _keyed(orderings: Orderings):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = orderings.keys(_matrix(batch.column("vector")))
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), lists], names=["rep", "keys"])

    return keyed


def _compare(keep: int):
    def compared(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "rep": [], "score": []}
        if rows.num_rows and queries.num_rows:
            ids, own = rows.column("rep").to_numpy(), queries.column("rep").to_numpy()
            points = _matrix(rows.column("vector"))
            unit = _unit(points)
            asked = _matrix(queries.column("vector"))
            size, most = np.linalg.norm(points, axis=1), min(keep, len(ids))
            for low in range(0, len(own), 512):
                part = asked[low : low + 512]
                near = _unit(part) @ unit.T
                # Whatever may tie with the last place is ranked exactly, by score and id.
                edge = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
                row, best = np.nonzero(near >= edge[:, None] - 1e-12)
                dot = (part[row] * points[best]).sum(axis=1)
                score = dot / (np.linalg.norm(part, axis=1)[row] * size[best])
                # Outside the range of doubles the scaled vectors give the cosine.
                score = np.where(np.isfinite(score), score, near[row, best])
                order = np.lexsort([ids[best], -score, row])
                row, best, score = row[order], best[order], score[order]
                first = np.searchsorted(row, row)
                kept = np.arange(len(row)) - first < keep
                row, best, score = row[kept], best[kept], score[kept]
                out["query"].append(own[low : low + 512][row])
                out["rep"].append(ids[best])
                out["score"].append(score)
        kinds = {"query": np.int64, "rep": np.int64, "score": np.float64}
        return pa.table({k: np.concatenate([np.zeros(0, kinds[k]), *v]) for k, v in out.items()})

    return compared


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    reach: float = REACH,
    orderings: int = ORDERINGS,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row.

    ``is_query`` is a condition on ``vectors``. Nearness is the cosine; ties go to the
    smaller id. A query never finds its own row.
    """
    whole = F.col("vector")
    sound = (
        F.col("vec_id").isNotNull()
        & (F.size(whole) > 0)
        & F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(whole, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.col(f"`{vector_col}`").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(sound)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    length = [row["n"] for row in sizes.collect()]
    rows = rows.filter(F.size("vector") == (length[0] if length else 0))

    copies = Window.partitionBy("vector").orderBy("vec_id")
    points = durable(
        rows.select("vec_id", "vector", F.dense_rank().over(copies).alias("place"))
        .filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("rep"), "ids", "vector")
    )
    asking = durable(
        rows.filter("asks").select("vec_id", "vector").distinct()
        .join(points.select("rep", "vector"), "vector")
        .select(F.col("vec_id").alias("query_id"), "rep")
    )
    total, asked = points.count(), asking.select("rep").distinct().count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not asked:
        return vectors.sparkSession.createDataFrame([], schema)

    sample = points.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas()["vector"]
    fitted = Orderings(np.array([list(v) for v in sample], dtype=np.float64), orderings, seed)
    cells = max(LEAST_CELLS, ceil(total / CELL_ROWS))
    index = durable(
        points.select("rep", "vector")
        .mapInArrow(_keyed(fitted), "rep bigint, keys array<bigint>")
        .select("rep", F.posexplode("keys").alias("ordering", "key"))
        .repartitionByRange(cells * orderings, "ordering", "key", F.xxhash64("rep"))
        .select("rep", "ordering", F.spark_partition_id().alias("cell"))
    )
    ends = index.groupBy("ordering").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    span = F.col("high") - F.col("low") + 1
    least = ceil(LEAST_WINDOW / 2 * cells / max(total, 1))
    half = F.greatest(F.lit(1), F.floor(span * reach / 2), F.lit(least)).cast("int")
    # A window at the end of the curve is moved inwards, not cut.
    start = F.greatest(F.least(F.col("cell") - half, F.col("high") - 2 * half), F.col("low"))
    windows = (
        index.join(asking.select("rep").distinct(), "rep")
        .join(F.broadcast(ends), "ordering")
        .withColumn("cell", F.explode(F.sequence(start, F.least(start + 2 * half, F.col("high")))))
        .select("rep", "ordering", "cell")
    )
    blocks = ceil(asked / BLOCK)
    right = windows.join(points.select("rep", "vector"), "rep").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.lit(blocks))
    )
    left = index.join(points.select("rep", "vector"), "rep").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    )
    group = ["ordering", "cell", "block"]
    right = right.select("rep", "vector", *group).toDF("rep", "vector", *group)
    found = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInArrow(_compare(k + 1), "query bigint, rep bigint, score double")
        .groupBy("query", "rep")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = (
        top.join(points.select("rep", "ids"), "rep")
        .groupBy("query")
        .agg(
            F.array_sort(
                F.flatten(
                    F.collect_list(
                        F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))
                    )
                )
            ).alias("near")
        )
    )
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    return (
        asking.join(lists, F.col("rep") == F.col("query"))
        .select("query_id", F.posexplode(others).alias("at", "hit"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"),
            (-F.col("hit.less")).alias("score"),
        )
    )
