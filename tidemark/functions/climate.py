"""Climate vocabulary and row-level rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip

# Climate type -> description.
DESCRIPTIONS = {
    "Clear": "晴天",
    "Clouds": "多云",
    "Rain": "雨天",
    "Drizzle": "小雨",
    "Thunderstorm": "雷暴",
    "Snow": "雪天",
    "Mist": "薄雾",
    "Fog": "大雾",
}

# Plausible range of each measure.
BOUNDS = {"humidity": (20, 95), "pressure": (980, 1040), "wind_speed": (0.5, 15)}


def describe(climate_type: Column) -> Column:
    """Description of a climate type; an unknown type stands for itself."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(DESCRIPTIONS.items())])
    return F.coalesce(F.try_element_at(names, climate_type), climate_type)


def classify(temperature: Column, humidity: Column, pressure: Column, precipitation: Column) -> Column:
    """Climate type by rule; null where no rule decides."""
    return (
        F.when(precipitation > 5, F.when(temperature > 0, "Rain").otherwise("Snow"))
        .when((humidity > 80) & (pressure < 1010), "Clouds")
        .when((humidity < 40) & (pressure > 1020), "Clear")
    )


def precipitation_icon(precipitation: Column) -> Column:
    """dry, mixed or wet, as the daily overview shows it."""
    return F.when(precipitation == 0, "dry").when(precipitation > 5, "wet").otherwise("mixed")


def clip_measure(name: str) -> Column:
    low, high = BOUNDS[name]
    return clip(F.col(name), low, high)
