"""Helpers for expressions over arrays inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands between words that are maximal runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of ``value``, which is computed once however often the function names it.

    Without this a value named inside a lambda function may be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), function), 1)


def spaced_words(text: str | Column) -> Column:
    """The words of a text; splitting is faster than extracting."""
    return F.array_remove(F.split(text, SPACES), "")
