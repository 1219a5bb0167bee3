"""Portable pseudo-randomness: the same number for the same keys on any engine.

Draws and shuffles must not depend on partitioning or on a retried task, so they
are taken from a digest of their keys and never from ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def digest(*parts) -> Column:
    """md5 of the parts joined by ``|``: 32 hex digits."""
    return F.md5(F.concat_ws("|", *[_text(part) for part in parts]))


def hex_number(text: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex digits of a digest as a bigint."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def stable_hash(*parts) -> Column:
    """A bigint in ``[0, 2**32)`` that depends on the parts alone."""
    return hex_number(digest(*parts))
