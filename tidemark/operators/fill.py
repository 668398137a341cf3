"""Gap filling and repair of daily series.

All operators here work within a series. Windows are partitioned by the series key only,
so a chain of them costs one shuffle; a series holds at most one row per day (and region),
which bounds what one task sees. Fills never cross from one series into the next. Where a
series may hold several rows of a date, ``ties`` names the columns that order them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import with_calendar, with_date_parts
from . import scan


def _so_far(key: Sequence[str], date: str, ties: Sequence[str] = (), descending: bool = False):
    """Rows up to the current one; rows of one date are in the order of the ``ties``."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in (date, *ties)]
    return W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def carry_forward(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], date: str = "date", ties: Sequence[str] = (), every: str | None = None,
) -> DataFrame:
    """Each null takes the last value before it.

    With ``every`` (day, hour, ...) a key is scanned by segments of that length, for keys that hold very many rows.
    """
    if every:
        found = scan.known_around(df, key, columns, date, ties, every)
        filled = found.withColumns({c: F.col(f"_prev_{c}")["v"] for c in columns})
        return filled.drop("_pos", *(f"_{side}_{c}" for side in ("prev", "next") for c in columns))
    w = _so_far(key, date, ties)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def carry_forward_or_reject(
    df: DataFrame, key: Sequence[str], column: str, date: str = "date", ties: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Carried-forward rows of complete series, and the keys that still hold a null."""
    filled = carry_forward(df, key, [column], date, ties)
    holes = F.count_if(F.col(column).isNull()).over(W.partitionBy(*key))
    marked = filled.withColumn("_holes", holes)
    complete = marked.filter(F.col("_holes") == 0).drop("_holes")
    rejected = marked.filter(F.col("_holes") > 0).groupBy(*key).agg(F.max("_holes").alias("n_missing"))
    return complete, rejected


def carry_then_zero(df: DataFrame, key: Sequence[str], columns: Sequence[str], date: str = "date", ties: Sequence[str] = ()) -> DataFrame:
    """Carry forward; what is still missing becomes 0."""
    w = _so_far(key, date, ties)
    return df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)) for c in columns
    })


def _interpolated(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], date: str, lead: bool,
    ties: Sequence[str] = (), every: str | None = None,
) -> DataFrame:
    """Linear by row position between known values; after the last one its value holds.

    Looking back and looking ahead are both running frames, the second over the reversed
    order: a frame to the end of the partition would be evaluated anew for every row.
    """
    if every:
        out = scan.known_around(df.withColumns({c: F.col(c).cast("double") for c in columns}), key, columns, date, ties, every)
    else:
        back, ahead = _so_far(key, date, ties), _so_far(key, date, ties, descending=True)
        known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col(c).cast("double").alias("v")))
                 for c in columns}
        out = df.withColumn("_pos", F.row_number().over(W.partitionBy(*key).orderBy(date, *ties)))
        out = out.withColumns({f"_prev_{c}": F.last(known[c], ignorenulls=True).over(back) for c in columns})
        out = out.withColumns({f"_next_{c}": F.last(known[c], ignorenulls=True).over(ahead) for c in columns})
    filled = {}
    for c in columns:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        step = F.try_divide(F.col("_pos") - prev["pos"], nxt["pos"] - prev["pos"])
        choices = [F.col(c), prev["v"] + (nxt["v"] - prev["v"]) * step, prev["v"]]
        if lead:
            choices.append(nxt["v"])
        filled[c] = F.coalesce(*choices)
    helpers = ["_pos", *[f"_{side}_{c}" for c in columns for side in ("prev", "next")]]
    return out.withColumns(filled).drop(*helpers)


def linear_fill(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], date: str = "date", ties: Sequence[str] = (), every: str | None = None,
) -> DataFrame:
    """Interpolate, carry the last value on and the first value back; ``every`` as in :func:`carry_forward`."""
    return _interpolated(df, key, columns, date, True, ties, every)


def interpolate(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], date: str = "date", ties: Sequence[str] = (), every: str | None = None,
) -> DataFrame:
    """Interpolate and carry the last value on; leading nulls stay; ``every`` as in :func:`carry_forward`."""
    return _interpolated(df, key, columns, date, False, ties, every)


def repair_observations(
    df: DataFrame, key: Sequence[str], numbers: Sequence[str], others: Sequence[str] = (), date: str = "date",
    ties: Sequence[str] = (), every: str | None = None,
) -> DataFrame:
    """Interpolate the numbers and carry all other columns forward.

    Raw readings of a city are not bounded by the calendar: give ``every`` to scan them by segments of time.
    """
    out = interpolate(df, key, numbers, date, ties, every)
    return carry_forward(out, key, others, date, ties, every) if others else out


def interpolate_or_mean(df: DataFrame, key: Sequence[str], column: str, date: str = "date", ties: Sequence[str] = ()) -> DataFrame:
    """Interpolate; leading nulls take the mean of the interpolated series."""
    out = interpolate(df, key, [column], date, ties)
    mean = F.avg(column).over(W.partitionBy(*key))
    return out.withColumn(column, F.coalesce(column, mean))


def outliers_to_median(
    df: DataFrame, key: Sequence[str], column: str = "value", multiplier: float = 1.5,
) -> DataFrame:
    """Values outside the quartile fences become the median (taken with the outliers in)."""
    quartiles = F.percentile(column, [0.25, 0.5, 0.75]).over(W.partitionBy(*key))
    q1, median, q3 = (F.col("_q")[i] for i in range(3))
    reach = (q3 - q1) * multiplier
    outside = (F.col(column) < q1 - reach) | (F.col(column) > q3 + reach)
    return (
        df.withColumn("_q", quartiles)
        .withColumn(column, F.when(outside, median).otherwise(F.col(column)))
        .drop("_q")
    )


def daily_spine(df: DataFrame, key: Sequence[str], date: str = "date") -> DataFrame:
    """Every day from the first to the last date of each key.

    Months are laid out first and days within them, so no row carries a long array.
    """
    span = df.groupBy(*key).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    months = span.withColumn(
        "_month", F.explode(F.sequence(F.trunc("_first", "month"), F.col("_last"), F.expr("interval 1 month")))
    )
    days = F.sequence(
        F.greatest(F.col("_first"), F.col("_month")), F.least(F.col("_last"), F.last_day("_month")),
        F.expr("interval 1 day"),
    )
    return months.select(*key, F.explode(days).alias(date))


def on_daily_spine(df: DataFrame, key: Sequence[str], date: str = "date") -> DataFrame:
    """The rows of ``df`` and, for each missing day, a row with nulls.

    The gap after a row is known from the next date of its series, so the missing days are
    laid out from the row itself. This needs the one shuffle by key the fills need anyway,
    and no join.
    """
    others = [c for c in df.columns if c not in key and c != date]
    until = F.lead(date).over(W.partitionBy(*key).orderBy(date))
    gap = F.when(F.col("_until") > F.date_add(date, 1),
                 F.sequence(F.col(date), F.date_sub("_until", 1), F.expr("interval 1 day")))
    laid_out = df.filter(F.col(date).isNotNull()).withColumn("_until", until).withColumn(
        "_day", F.explode(F.coalesce(gap, F.array(date)))
    )
    own = F.col("_day") == F.col(date)
    return laid_out.select(
        *key, F.col("_day").alias(date), *[F.when(own, F.col(c)).alias(c) for c in others]
    )


def daily_continuity(df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date") -> DataFrame:
    """Insert the missing days and fill the value on them; other columns stay null there."""
    return linear_fill(on_daily_spine(df, key, date), key, [value], date)


def number_days(df: DataFrame, key: Sequence[str], sequence: str, start: str = "2020-01-01", date: str = "date") -> DataFrame:
    """Give rows without dates consecutive days, in the order of a sequence column."""
    pos = F.row_number().over(W.partitionBy(*key).orderBy(sequence))
    return df.withColumn(date, F.date_add(F.lit(start).cast("date"), pos - 1))


def forecast_input(df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date") -> DataFrame:
    """Fill by interpolation and mean, and add the date parts."""
    return with_date_parts(interpolate_or_mean(df, key, value, date), date)


def modelling_table(df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date") -> DataFrame:
    """Fill, replace outliers, make daily, add calendar, lag and rolling columns; one shuffle."""
    from .features import add_lags, add_rolling

    out = linear_fill(df, key, [value], date)
    out = outliers_to_median(out, key, value)
    out = daily_continuity(out, key, value, date)
    out = with_calendar(out, date)
    out = add_lags(out, key, value, (1, 2, 3, 7), date)
    return add_rolling(out, key, value, (7, 14, 30), ("mean", "std"), date)
