"""Errors raised when data breaks a rule an operator depends on."""

from __future__ import annotations


class TidemarkError(Exception):
    """Base class of every error raised here."""


class SchemaError(TidemarkError):
    """A column an operator needs is missing."""


class IdentityError(TidemarkError):
    """Item identities are malformed or repeated."""


class VocabularyError(TidemarkError):
    """A tagging vocabulary is malformed."""


class SplitError(TidemarkError):
    """Folds leak a group, miss an item, or cannot be built."""


class TaskError(TidemarkError):
    """No task, or no item for a task."""


class ComparisonError(TidemarkError):
    """Two sets of scores cannot honestly be compared."""


class FamilyError(TidemarkError):
    """A result has no control, or more than one."""


class ExtractionIncomplete(TidemarkError):
    """Kept items produced no windows."""


class MissingResults(TidemarkError):
    """An expected result set is absent."""


def require_columns(df, *names: str, error=SchemaError) -> None:
    """Raise when a frame lacks one of the named columns; reads the schema only."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise error(f"missing columns: {missing}")
