"""Running totals over a total order, without a window that needs one task.

A Spark window with few (or no) partition keys sends a whole key to one task. Here
the rows are range partitioned by ``keys + order``, so a hot key is spread over many
partitions; each partition contributes one total per key, the running sum of those
few totals becomes an offset, and the window itself only runs inside a partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "__part"

_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def shared_folder(session: SparkSession) -> str:
    """The folder every executor can read, as the session's ``spark.checkpoint.dir`` names it.

    Only a local session that names none gets a folder of its own.
    """
    context = session.sparkContext
    folder = session.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if folder is None and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    return folder.rstrip("/")


def durable(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and go on from the written table.

    The lineage ends there, so a lost executor costs a re-read and nothing upstream can
    come out differently the second time; later plans see the table's real size. ``compression`` may
    name another codec than the session's.
    """
    session = df.sparkSession
    path = f"{shared_folder(session)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return session.read.schema(df.schema).parquet(path)


class Ordered:
    """Rows laid out by ``keys`` and then by ``order``, ready for running totals.

    ``order`` is a list of ``(column, ascending)``; together with the keys it should
    identify a row, so aggregate ties away first. A null key fails the job.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]):
        self.keys = list(keys)
        self.order = list(order)
        layout = [F.col(key) for key in self.keys] + self._sorting(False)
        kinds = dict(df.dtypes)
        # A null key would drop out of the join with the offsets: refuse it instead.
        for key in self.keys:
            fail = F.raise_error(F.lit(f"rows with a null {key} cannot be ordered by it"))
            df = df.withColumn(key, F.coalesce(F.col(key), fail.cast(kinds[key])))
        self.frame = durable(
            df.repartitionByRange(*layout).withColumn(PART, F.spark_partition_id())
        )

    def _sorting(self, reverse: bool) -> list[Column]:
        return [
            F.col(name).asc() if ascending != reverse else F.col(name).desc()
            for name, ascending in self.order
        ]

    def running(
        self,
        frame: DataFrame,
        measures: dict[str, tuple[str, Column]],
        *,
        reverse: bool = False,
    ) -> DataFrame:
        """Add inclusive running measures; ``frame`` is ``self.frame`` or derived from it.

        ``measures`` maps an output name to ``("sum" | "min" | "max", value)``. With
        ``reverse`` the totals run from the end of the order to its start.
        """
        block = [*self.keys, PART]
        totals = frame.groupBy(*block).agg(
            *[_KINDS[kind](value).alias(name) for name, (kind, value) in measures.items()]
        )
        earlier = (
            Window.partitionBy(*(self.keys or [F.lit(0)]))
            .orderBy(F.desc(PART) if reverse else F.asc(PART))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = totals.select(
            *block,
            *[
                _KINDS[kind](name).over(earlier).alias(f"__before_{name}")
                for name, (kind, _) in measures.items()
            ],
        )
        inside = (
            Window.partitionBy(*block)
            .orderBy(*self._sorting(reverse))
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        joined = frame.join(offsets, block)
        for name, (kind, value) in measures.items():
            here, before = _KINDS[kind](value).over(inside), F.col(f"__before_{name}")
            if kind == "sum":
                joined = joined.withColumn(name, here + F.coalesce(before, F.lit(0)))
            else:
                pick = F.least if kind == "min" else F.greatest
                joined = joined.withColumn(name, pick(here, before))
        return joined.drop(*[f"__before_{name}" for name in measures])


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "position"
) -> DataFrame:
    """Zero-based position of every row inside its key; ``order`` must be unique there."""
    laid = Ordered(df, keys, order)
    ranked = laid.running(laid.frame, {name: ("sum", F.lit(1).cast("bigint"))})
    return ranked.withColumn(name, F.col(name) - 1).drop(PART)
