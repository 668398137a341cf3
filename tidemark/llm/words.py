"""Words of a text as column expressions: maximal stretches without ASCII white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
BETWEEN = r"[\x20\x09-\x0D]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: the only element of an array is bound to a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words_of(text: Column) -> Column:
    """The words of a text that is not null, in order."""
    def split(inner: Column) -> Column:
        return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BETWEEN, -1))

    return bound(stripped(text), split)
