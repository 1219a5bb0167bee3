"""Registered queries: every operator bound to the driver tables, with an oracle.

Importing the modules below fills ``QUERIES`` and ``ORACLES``.
"""

from tidemark.catalog.base import ORACLES, QUERIES
from tidemark.catalog import audits, comparisons, models, scores, signals, splits, texts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
