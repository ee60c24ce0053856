"""Typed reading of stored text values; nothing here fails on a bad value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as booleans, and texts that stand for unavailable.
TRUE_WORDS = ("1", "true", "yes")
FALSE_WORDS = ("0", "false", "no")
PLACEHOLDERS = ("n/a", "")


def is_placeholder(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*PLACEHOLDERS)


def available(value: Column) -> Column:
    """The value, or NULL where it only marks something unavailable."""
    return F.when(~is_placeholder(value), value)


def typed(value: Column, fmt: str) -> Column:
    """Read a stored text by its declared format; unreadable values become NULL."""
    value = available(value)
    if fmt == "number":
        return value.try_cast("double")
    if fmt == "boolean":
        word = F.lower(F.trim(value))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return value
