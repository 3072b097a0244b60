"""Small helpers for string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def first_part(text: Column, separator: str = ",") -> Column:
    """What stands before the first separator; the whole text if there is none."""
    return F.substring_index(text, separator, 1)


def after_first(text: Column, separator: str = ",") -> Column:
    """What stands after the first separator; null if there is none."""
    at = F.locate(separator, text)
    return F.when(at > 0, F.substring(text, at + len(separator), F.length(text)))


def starts(text: Column, prefix: Column) -> Column:
    return F.startswith(text, prefix)
