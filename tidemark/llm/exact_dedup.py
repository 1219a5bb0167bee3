"""Exact duplicates by a heavy-hitter split.

A frequent-items pass (the Misra-Gries family: at most ``1 / support`` counters in any
task, merged by Spark) names every digest that could hold more than ``support`` of the
rows. The candidates are counted exactly; those that really are frequent are the
winners, at most ``1 / support`` rows, and are broadcast: their members are decided where
they lie, without a shuffle. All other digests hold less than that share of the rows and
meet in one ordinary shuffle.

Null texts count as empty. A null id sorts below every other. Rows that repeat an id and a
text count in ``group_size``; one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import document_rows, keep_rows
from tidemark.operators.ordered import durable

#: Share of the rows above which a digest is decided on the map side.
SUPPORT = 1 / 512


def equal_groups(rows: DataFrame, digest: str, member: str, support: float = SUPPORT) -> DataFrame:
    """Add ``winner`` (the largest ``member`` of equal digests) and ``group_size``.

    ``rows`` is read several times and should be a written table; ``member`` is any
    orderable column, structs included.
    """
    frequent = rows.stat.freqItems([digest], support).select(
        F.explode(F.col(f"{digest}_freqItems")).alias(digest)
    )
    floor = support * rows.count()
    winners = durable(
        rows.join(F.broadcast(frequent), digest)
        .groupBy(digest)
        .agg(F.max(member).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > floor)
    )
    hot = rows.join(F.broadcast(winners), digest)
    equal = Window.partitionBy(digest)
    cold = rows.join(F.broadcast(winners.select(digest)), digest, "left_anti").select(
        *rows.columns,
        F.max(member).over(equal).alias("winner"),
        F.count(F.lit(1)).over(equal).alias("group_size"),
    )
    return hot.select(*cold.columns).unionByName(cold)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per row of ``docs``: which row of its group of identical texts stays.

    Columns: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. The row
    with the largest id stays.
    """
    rows = document_rows(docs, id_col, text_col)
    # The row number only tells repeated rows apart; it is fixed by being written.
    digests = durable(
        rows.select(
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("member"),
        )
    )
    found = equal_groups(digests, "text_sha256", "member", support)
    return found.select(
        F.col("member.doc_id").alias("doc_id"),
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        F.col("member").eqNullSafe(F.col("winner")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one of each group of identical texts, columns unchanged.

    A row is found again by its id and its text's digest, so two different texts under
    one id are two documents.
    """
    stays = exact_dedup(docs, id_col, text_col).filter("kept")
    decided = stays.select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("digest"))
    return keep_rows(docs, decided, id_col, text_col)
