"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a batch between the JVM and Python, where the session leaves Spark's default.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Texts are long: keep the batches that pass to Python small, unless the session says otherwise."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def document_rows(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that no other name can clash.

    A null text counts as empty; a null id stays null.
    """
    return small_batches(df).select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *[F.col(f"`{name}`").alias(name) for name in more],
    )


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``: the folds of the labelled rows."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(of)).cast("int")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``decided(keep, digest)``, one row for each.

    Rows that repeat an id and a text are one document; two texts under one id are two. Ids
    may be null and match a null.
    """
    key = free_name(docs, "__key")
    named = docs.withColumn(key, null_safe(F.col(f"`{id_col}`").cast("bigint"), text_digest(F.col(f"`{text_col}`"))))
    chosen = decided.select(null_safe(F.col("keep"), F.col("digest")).alias(key))
    # One key for the join and for what repeats, so that the texts are shuffled once.
    kept = named.join(chosen, key, "left_semi").dropDuplicates([key])
    return kept.select(*[f"`{name}`" for name in docs.columns])


def null_safe(*parts: Column) -> Column:
    """The parts as one text that is never null and tells a null from any value."""
    return F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit("null")) for part in parts])
