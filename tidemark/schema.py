"""Canonical relations and the normalisation every operator relies on.

Missing numbers are null, never NaN or infinity: Spark aggregates do not skip NaN and
``NaN > x`` is true, so sources call :func:`finite` once and operators rely on null rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _D, _F, _B, _TS = T.StringType(), T.DateType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

MAIN = _struct(("region", _S), ("date", _D), ("value", _F))
CUSTOMER = _struct(("customer_id", _S), ("region", _S), ("date", _D), ("value", _F))
CLIMATE = _struct(
    ("city", _S), ("date", _D), ("temperature", _F), ("humidity", _F), ("pressure", _F),
    ("wind_speed", _F), ("precipitation", _F), ("cloud_cover", _F),
    ("is_holiday", _B), ("is_weekend", _B), ("data_source", _S),
)
DAILY_CLIMATE = _struct(
    ("city", _S), ("date", _D), ("max_temperature", _F), ("min_temperature", _F),
    ("precipitation", _F), ("data_type", _S),
)

# Payload of the daily provider: parallel arrays under "daily".
DAILY_PAYLOAD = T.StructType([
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(_S)),
        T.StructField("temperature_2m_max", T.ArrayType(_F)),
        T.StructField("temperature_2m_min", T.ArrayType(_F)),
        T.StructField("precipitation_sum", T.ArrayType(_F)),
    ])),
])

# Payload of the 3-hourly provider: a list of nested readings. The names of its fields.
READINGS_PAYLOAD = T.StructType([
    T.StructField("list", T.ArrayType(T.StructType([
        T.StructField("dt", T.LongType()),
        T.StructField("main", _struct(("temp", _F), ("humidity", _F), ("pressure", _F))),
        T.StructField("wind", _struct(("speed", _F))),
        T.StructField("rain", _struct(("3h", _F))),
        T.StructField("weather", T.ArrayType(_struct(("main", _S), ("description", _S)))),
    ]))),
])

# Payload of the city search.
GEOCODE_PAYLOAD = T.StructType([
    T.StructField("results", T.ArrayType(_struct(
        ("name", _S), ("latitude", _F), ("longitude", _F), ("timezone", _S),
    ))),
])


def finite(col: Column) -> Column:
    """The number, or null when it is NaN or infinite."""
    return F.when(F.abs(F.nanvl(col, F.lit(None).cast("double"))) < F.lit(float("inf")), col)


def to_number(col: Column) -> Column:
    """Coerce to a finite double; what does not parse becomes null."""
    return finite(col.try_cast("double"))


def to_instant(col: Column) -> Column:
    """Coerce to a wall-clock time, midnight for a date; what does not parse becomes null."""
    return col.cast("string").try_cast("timestamp_ntz")


def to_date(col: Column, fmt: str | None = None) -> Column:
    """Coerce to a date; what does not parse becomes null."""
    if fmt is None:
        return col.cast("string").try_cast("date")
    return F.try_to_timestamp(col.cast("string"), F.lit(fmt)).cast("date")


def utc_instant(df: DataFrame, name: str) -> Column:
    """A column as an instant in any session zone; wall-clock values without zone are taken as UTC."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp")
    return F.col(name).cast("timestamp")


def utc_day(instant: Column) -> Column:
    """The UTC date of an instant."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86_400).cast("int"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def check_columns(df: DataFrame, required: list[str]) -> dict:
    """Which required columns are there and which are not; looks at the schema, starts no job."""
    missing = [c for c in required if c not in df.columns]
    return {
        "is_valid": not missing,
        "missing_columns": missing,
        "available_columns": list(df.columns),
        "column_types": dict(df.dtypes),
    }
