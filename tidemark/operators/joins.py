"""Joining facts about a value back onto its rows when one value may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most this many table rows are broadcast, whatever the data size. A value that
# is not among them holds less than 1/256 of the rows.
HOT_VALUES = 256


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition a frame into the session's full number of shuffle partitions.

    For use before each row expands into very many: adaptive execution sizes partitions
    by what is there now, and would leave a small input to one task.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    weight: str,
    *,
    spread: Sequence[str] | None = None,
    how: str = "left",
    shuffled: bool = False,
) -> DataFrame:
    """Join ``table`` (one row per value of ``on``) to ``rows``, skew safe.

    ``weight`` is the column of ``table`` that says how many rows carry the value; it
    is not joined. The heaviest 256 values are broadcast, and the rows they serve
    carry a nonce in the shuffle key, so they spread instead of meeting in one task;
    so do rows whose key is null. All other values meet in an ordinary join. ``shuffled`` rules out
    that Spark broadcasts the whole table, for one that is far larger than the files it is made from.
    """
    on = list(on)
    payload = [name for name in table.columns if name not in (*on, weight)]
    hot = (
        table.orderBy(F.desc(weight), *on)
        .limit(HOT_VALUES)
        .select(*on, F.struct(*payload).alias("__hot"))
    )
    tagged = rows.join(F.broadcast(hot), on, "left")
    blank = F.lit(False)
    for name in on:
        blank = blank | F.col(name).isNull()
    nonce = F.when(
        F.col("__hot").isNotNull() | blank,
        F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(1 << 20)) + 1,
    ).otherwise(F.lit(0).cast("bigint"))
    cold = table.select(
        *on, F.lit(0).cast("bigint").alias("__nonce"), F.struct(*payload).alias("__cold")
    )
    if shuffled:
        cold = cold.hint("merge")
    joined = tagged.withColumn("__nonce", nonce).join(cold, [*on, "__nonce"], "left")
    found = F.coalesce("__hot", "__cold")
    if how == "inner":
        joined = joined.filter(found.isNotNull())
    joined = joined.withColumn("__found", found)
    return joined.select(
        *rows.columns, *[F.col("__found")[name].alias(name) for name in payload]
    )
