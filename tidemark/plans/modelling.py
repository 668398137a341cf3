"""Modelling data of many series with the climate beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import fill, climate


def modelling_data(main: DataFrame, key: Sequence[str] = ("region",), value: str = "value",
                   observations: DataFrame | None = None) -> DataFrame:
    """Filled, repaired, daily rows with calendar, lag and rolling columns, enriched with climate."""
    table = fill.modelling_table(main, key, value)
    return table if observations is None else climate.enrich(table, observations, key)
