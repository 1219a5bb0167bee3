"""Near-duplicate documents by b-bit MinHash with exact confirmation.

1. One pass over the texts gives each document its shingle set's size and fingerprint,
   the keys of ``BANDS`` bands of ``ROWS`` minima, and the low 4 bits of every minimum,
   packed into eight longs. Equal sets are one class from here on.
2. A bucket is the classes that share a band key. Each class is paired with the hub of
   its bucket, the class that shares the most band keys with others; classes of small
   buckets are paired with each other. A pair is kept if the similarity estimated from the
   packed bits, corrected for chance collisions, is within ``MARGIN`` of the threshold.
3. The links of kept pairs are confirmed on the full shingle sets and joined to
   components.
4. Only pairs of one bucket that still lie in different components remain. Those that
   cannot reach the threshold are excluded exactly: a shingle that no other candidate
   holds is in no intersection. The rest is estimated and confirmed like the others.

So a group of n near copies costs about n confirmations and not n squared, and no link
that could join two components is left out.

Null and empty texts have an empty set, are linked with nothing and keep their own id.
A document is an id and a text: rows that repeat both are one document, and two texts under
one id are two, each linked by its own set. Of documents with the component's id the least
digest is kept. A document with a null id takes no part in links and is its own component
(null, kept), unless a document with an id has the same set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, merged
from tidemark.llm.rows import document_rows, keep_rows, text_digest
from tidemark.llm.words import buffers, mix, shingle_sets, slices
from tidemark.operators.ordered import durable

BANDS, ROWS, BITS = 24, 5, 4
MINIMA = BANDS * ROWS
#: An estimate over 120 minima has a deviation of 0.035 at most near the threshold.
MARGIN = 0.15
#: Buckets up to this many classes are paired in full before the first components.
SMALL = 16
#: A bucket of n candidates is cut into about the root of n / SHARE blocks.
SHARE = 256

_draw = np.random.default_rng(5)
_FACTORS = _draw.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_TERMS = _draw.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_BAND = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_MARKS = _draw.integers(0, 1 << 64, 2, dtype=np.uint64)
_SHIFTS = (np.arange(16, dtype=np.uint64) * np.uint64(BITS))[None, None, :]

SIGNED = "doc_id bigint, digest string, n_shingles bigint, mark_a bigint, mark_b bigint, bands array<bigint>, bits array<bigint>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the ``MINIMA`` permutations of 32 bits."""
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 512):
        block = np.multiply.outer(short[start : start + 512], _FACTORS)
        block += _TERMS
        np.minimum(least, block.min(axis=0), out=least)
    return least


def _lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1).view(np.int64))
    )


def _sign(size: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = buffers(part.column("text"))
                n = part.num_rows
                least = np.empty((n, MINIMA), np.uint32)
                count, marks = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
                for i, shingles in enumerate(shingle_sets(raw, offsets, size)):
                    least[i], count[i] = minima(shingles), len(shingles)
                    for k in range(2):
                        marks[i, k] = mix(shingles ^ _MARKS[k]).sum(dtype=np.uint64)
                keys = mix((least.reshape(n, BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2))
                low = np.zeros((n, 128), np.uint64)
                low[:, :MINIMA] = least & np.uint32((1 << BITS) - 1)
                packed = (low.reshape(n, 8, 16) << _SHIFTS).sum(axis=2, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("digest"),
                        pa.array(count),
                        pa.array(marks[:, 0].copy().view(np.int64)),
                        pa.array(marks[:, 1].copy().view(np.int64)),
                        _lists(keys),
                        _lists(packed),
                    ],
                    names=["doc_id", "digest", "n_shingles", "mark_a", "mark_b", "bands", "bits"],
                )

    return signed


def _sets(size: int):
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [s.view(np.int64) for s in shingle_sets(*buffers(part.column("text")), size)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "shingles"])

    return shingled


def estimate(left: Column, right: Column) -> Column:
    """Similarity from two packed signatures: equal 4-bit cells, less chance collisions."""
    equal = F.lit(MINIMA)
    for k in range(8):
        cells = left[k].bitwiseXOR(right[k])
        cells = cells.bitwiseOR(F.shiftrightunsigned(cells, 1))
        cells = cells.bitwiseOR(F.shiftrightunsigned(cells, 2))
        equal = equal - F.bit_count(cells.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1 / (1 << BITS)
    return (equal / F.lit(float(MINIMA)) - chance) / (1 - chance)


def _reaches(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n_a + n_b - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(_reaches(shared, F.size("set_a"), F.size("set_b"), percent)).select("a", "b")


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    size: int = 3,
    percent: int = 85,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if ``100 * |intersection| >= percent * |union|`` for their sets of
    ``size``-word shingles; the component is the least id that links reach.
    """
    return _judged(docs, id_col, text_col, size, percent).drop("digest")


def _judged(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``near_components`` with the digest of each row's text."""
    rows = document_rows(docs, id_col, text_col).withColumn("digest", text_digest(F.col("text")))
    signed = durable(rows.mapInArrow(_sign(size), SIGNED))
    alike = ["n_shingles", "mark_a", "mark_b"]
    classes = durable(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy(*alike)
        .agg(
            F.min(F.struct("doc_id", "digest")).alias("first"),
            F.min_by(F.struct("bands", "bits"), "doc_id").alias("sketch"),
        )
        # Ids may repeat among classes; the number tells them apart and is fixed by being written.
        .withColumn("node", F.monotonically_increasing_id())
    )
    linked = classes.select("node", "first").join(_placed(rows, classes, size, percent), "node")
    leasts = linked.groupBy("component").agg(F.min("first").alias("least"))
    found = linked.join(leasts, "component").select("node", "least")
    named = classes.join(found, "node", "left").select(*alike, F.coalesce("least", "first").alias("least"))
    # The hot classes are few rows on one side, so adaptive execution can split the other.
    placed = signed.join(named, alike, "left")
    # An empty set, and one that only null ids have, is in no class.
    least = F.coalesce("least", F.struct("doc_id", "digest"))
    return placed.select(
        "doc_id",
        "digest",
        "n_shingles",
        least["doc_id"].alias("component_id"),
        (F.col("doc_id").eqNullSafe(least["doc_id"]) & (F.col("digest") == least["digest"])).alias("kept"),
    )


def _placed(rows: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` of every class that is linked with another."""
    floor = percent / 100 - MARGIN
    banded = classes.select(
        "node", "n_shingles", F.col("sketch.bits").alias("bits"), F.posexplode("sketch.bands").alias("band", "key")
    )
    crowded = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = durable(banded.join(crowded, ["band", "key"]))
    reach = members.groupBy("node").agg(F.sum("members").alias("reach"))
    hubs = (
        members.join(reach, "node")
        .groupBy("band", "key")
        .agg(
            F.max_by(
                F.struct("node", "bits"), F.struct("reach", (-F.col("node")).alias("first"))
            ).alias("hub")
        )
    )
    to_hub = (
        members.join(hubs, ["band", "key"])
        .filter(F.col("node") != F.col("hub.node"))
        .filter(estimate(F.col("bits"), F.col("hub.bits")) >= floor)
        .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    )
    small = members.filter(F.col("members") <= SMALL)
    within = _bucket_pairs(small, small, floor)
    pairs = durable(to_hub.unionByName(within).distinct())

    wanted = members.select("node").distinct().join(classes, "node").select("first.doc_id", "first.digest", "node")
    # Rows that repeat an id and a text have the same set: one of them is enough.
    sets = durable(
        rows.join(wanted, ["doc_id", "digest"])
        .select("node", "text")
        .dropDuplicates(["node"])
        .mapInArrow(_sets(size), "node bigint, shingles array<bigint>")
    )
    first = durable(_confirmed(pairs, sets, percent))

    # What is left: pairs of one large bucket in different components.
    placed = durable(components(first))
    large = (
        members.filter(F.col("members") > SMALL)
        .join(placed, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    mixed = (
        large.groupBy("band", "key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("band", "key")
    )
    large = large.join(mixed, ["band", "key"], "left_semi")
    shared = (
        sets.select("node", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node"))
        .filter("holders = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    bounded = (
        large.join(shared, "node", "left")
        .withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
        .filter(100 * F.col("common") >= percent * F.col("n_shingles"))
    )
    bounded = durable(bounded.select("band", "key", "node", "n_shingles", "bits", "component", "common"))
    blocked = _blocked(bounded).join(classes.select("node", F.col("sketch.bands").alias("bands")), "node")
    second = _crossing_links(blocked.join(sets, "node"), floor, percent)
    return merged(placed, durable(second.distinct()))


def _blocked(rows: DataFrame) -> DataFrame:
    """Add ``blocks``, into how many its bucket is cut, and ``block``, which of them a row is in.

    The number grows with the root of the bucket's rows: so does how often a row is copied.
    """
    blocks = F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(SHARE))).cast("int")
    crowded = rows.groupBy("band", "key").agg(blocks.alias("blocks")).filter("blocks > 1")
    cut = rows.join(crowded, ["band", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return cut.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))


def _same_bucket() -> Column:
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))
    return met & (F.col("x.node") < F.col("y.node"))


def _bucket_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Pairs of one bucket whose estimate reaches ``floor``, each named low id first."""
    x, y = left.alias("x"), right.alias("y")
    met = _same_bucket() & (estimate(F.col("x.bits"), F.col("y.bits")) >= floor)
    return x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _crossing_links(rows: DataFrame, floor: float, percent: int) -> DataFrame:
    """Confirmed links between different components of one bucket.

    All of it is the join's condition, so only links are ever rows: the bound from common
    shingles and the estimate first, then whether this is the first band the two share,
    and the full sets last. Two blocks of a bucket meet in one task. They are dealt out here, as
    a join that Spark splits by itself takes a task for each two pieces of a large bucket, and
    the driver keeps account of them all.
    """
    place = ["band", "key", "low", "high"]
    last = F.col("blocks") - 1
    x = rows.withColumns({"low": F.col("block"), "high": F.explode(F.sequence("block", last))})
    y = rows.withColumns({"low": F.explode(F.sequence(F.lit(0), "block")), "high": F.col("block")})
    x, y = x.repartition(*place).alias("x"), y.repartition(*place).alias("y")
    least = F.least("x.common", "y.common")
    n_x, n_y = F.col("x.n_shingles"), F.col("y.n_shingles")
    hopeful = F.col("x.component") != F.col("y.component")
    hopeful = hopeful & _reaches(least, n_x, n_y, percent)
    hopeful = hopeful & (estimate(F.col("x.bits"), F.col("y.bits")) >= floor)
    equal = F.zip_with("x.bands", "y.bands", lambda a, b: a == b)
    first_met = F.array_position(equal, F.lit(True)) == F.col("x.band") + 1
    shared = F.size(F.array_intersect("x.shingles", "y.shingles"))
    linked = F.when(hopeful, F.when(first_met, _reaches(shared, n_x, n_y, percent)))
    met = F.lit(True)
    for name in place:
        met = met & (F.col(f"x.{name}") == F.col(f"y.{name}"))
    # Inside a block each two rows would meet twice.
    once = (F.col("x.low") < F.col("x.high")) | (F.col("x.node") < F.col("y.node"))
    links = x.join(y, met & once & F.coalesce(linked, F.lit(False)))
    return links.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, columns unchanged.

    The contract's shingles are three words at 85 %; here, as in any stage on word
    shingles, five words at 80 %.
    """
    found = _judged(docs, id_col, text_col, 5, 80).filter("kept")
    return keep_rows(docs, found.select(F.col("doc_id").alias("keep"), "digest"), id_col, text_col)
