"""One row per item: identity, label, and the exclusion decided once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import IdentityError, require_columns

RATE_TOO_LOW = "native_rate_below_target"
TOO_SHORT = "clip_too_short"


def parse_identity(df: DataFrame, path: str, id_length: int) -> DataFrame:
    """Read ``<class>/<year>/<id>.wav`` into class, year, item_id, group_id, cut_id.

    A path that does not fit keeps its row, with the reason in ``parse_error``.
    """
    # Empty and "." components carry no name, as in any POSIX path.
    pieces = F.filter(
        F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"),
        lambda piece: (piece != "") & (piece != "."),
    )
    df = df.withColumn("__pieces", pieces)
    parts = F.col("__pieces")
    name = F.element_at(parts, -1)
    stem = F.substring(name, F.lit(1), F.length(name) - 4)
    error = (
        F.when(F.size(parts) != 3, "not_three_parts")
        .when(~F.lower(name).endswith(".wav"), "not_wav")
        .when(~F.get(parts, 1).rlike(r"^\d+$"), "year_not_numeric")
        .when(F.get(parts, 1).try_cast("int").isNull(), "year_out_of_range")
        .when(F.length(stem) < id_length, "id_too_short")
        .otherwise("")
    )
    fine = F.col("parse_error") == ""

    def good(value: Column) -> Column:
        return F.when(fine, value)

    return (
        df.withColumn("parse_error", F.coalesce(error, F.lit("not_three_parts")))
        .withColumn("class", good(F.get(parts, 0)))
        .withColumn("year", good(F.get(parts, 1).try_cast("int")))
        .withColumn("item_id", good(stem))
        .withColumn("group_id", good(F.substring(stem, 1, id_length)))
        .withColumn("cut_id", good(F.substring(stem, F.lit(id_length + 1), F.length(stem))))
        .drop("__pieces")
    )


def strict(df: DataFrame, error: str = "parse_error") -> DataFrame:
    """Fail the job on the first row that carries an error text."""
    guard = F.when(F.col(error) == "", F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("malformed item: "), F.col(error))).cast("boolean")
    )
    return df.filter(guard)


def with_drop_reason(
    df: DataFrame,
    *,
    min_rate: float,
    min_seconds: float,
    rate: str = "native_rate",
    seconds: str = "duration",
) -> DataFrame:
    """First exclusion rule that applies, and ``keep`` when none does."""
    reason = (
        F.when(F.col(rate) < min_rate, RATE_TOO_LOW)
        .when(F.col(seconds) < min_seconds, TOO_SHORT)
        .otherwise("")
    )
    return df.withColumn("drop_reason", reason).withColumn("keep", F.col("drop_reason") == "")


def label_index(name: Column, class_names: Sequence[str], unknown: str = "fail") -> Column:
    """Position of a class in the configured list.

    A class not in it fails the job; ``unknown="null"`` is for corpora with classes that are
    not studied, whose rows are to be left out.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in class_names]), name)
    found = F.when(place > 0, (place - 1).cast("int"))
    if unknown == "null":
        return found
    return found.when(
        name.isNotNull(), F.raise_error(F.concat(F.lit("no such class: "), name)).cast("int")
    )


def duplicate_items(df: DataFrame, item: str = "item_id") -> DataFrame:
    """Item ids that occur more than once."""
    return (
        df.groupBy(item)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def check_items(df: DataFrame, item: str = "item_id", group: str = "group_id") -> DataFrame:
    """Required columns present and ids unique, or an error that names some of them."""
    require_columns(df, item, group, "label", "class")
    repeated = [row[0] for row in duplicate_items(df, item).orderBy(item).limit(5).collect()]
    if repeated:
        raise IdentityError(f"item ids are not unique: {repeated}")
    return df


def below_band(df: DataFrame, target_rate: float, rate: str = "native_rate") -> DataFrame:
    """Kept rows that would have to be up-sampled; must be empty."""
    return df.filter(F.col("keep") & (F.col(rate) < target_rate))
