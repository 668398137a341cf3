"""Canonical columns, de-duplication, gates and row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import to_date, to_number


def canonical_main(
    df: DataFrame, date: str = "date", value: str = "value", region: str | Column = "region",
    extra: Sequence[str] = (),
) -> DataFrame:
    """``region, date, value``; bad dates and numbers become null. A Column sets a constant region."""
    region_col = region if isinstance(region, Column) else F.col(region).cast("string")
    return df.select(
        region_col.alias("region"), to_date(F.col(date)).alias("date"),
        to_number(F.col(value)).alias("value"), *extra,
    )


def canonical_customers(
    df: DataFrame, customer: str = "customer_id", date: str = "date", value: str = "value",
    region: str = "region", extra: Sequence[str] = (),
) -> DataFrame:
    """``customer_id, region, date, value``. A missing customer stays null (it does not become a name)."""
    return df.select(
        F.col(customer).cast("string").alias("customer_id"), F.col(region).cast("string").alias("region"),
        to_date(F.col(date)).alias("date"), to_number(F.col(value)).alias("value"), *extra,
    )


def _nulls_last(df: DataFrame, column: str) -> Column:
    """A column to rank by; whole numbers stay plain, which lets the aggregate hash instead of sort."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return F.coalesce(F.col(column).cast("bigint"), F.lit(2**63 - 1))
    return F.struct(F.col(column).isNull(), F.col(column))


def keep_first(
    df: DataFrame, keys: Sequence[str], order: str | None = None, copies: str | None = None,
) -> DataFrame:
    """One row per key: the first by ``order``, or by all other columns ascending, nulls last.

    Files have no row order on a cluster, so "first" needs a column to say it; it should not
    repeat within a key. This is an aggregate and not a ranking window: copies collapse
    before the shuffle, however many of them one key has. ``copies`` names a column for how
    many rows the kept one stands for.
    """
    rest = [c for c in df.columns if c not in keys]
    counted = [F.count("*").alias(copies)] if copies else []
    names = [*df.columns, *([copies] if copies else [])]
    if order is not None:
        payload = [c for c in rest if c != order]
        rank = _nulls_last(df, order)
        first = [F.min(order).alias(order)]
        if len(payload) == 1:
            first.append(F.min_by(payload[0], rank).alias(payload[0]))
            return df.groupBy(*keys).agg(*first, *counted).select(*names)
        first.append(F.min_by(F.struct(*payload), rank).alias("_kept"))
        kept = df.groupBy(*keys).agg(*first, *counted)
        return kept.select(*[F.col("_kept")[c].alias(c) if c in payload else F.col(c) for c in names])
    if len(rest) == 1:
        return df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0]), *counted).select(*names)
    ranked = F.struct(*[x for c in rest for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))])
    kept = df.groupBy(*keys).agg(F.min(ranked).alias("_kept"), *counted)
    return kept.select(*[F.col("_kept")[c].alias(c) if c in rest else F.col(c) for c in names])


def daily_series(df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date") -> DataFrame:
    """Total per key and day; rows without key or date are dropped.

    This is what bounds every later per-key window: however many rows one key has, what is
    shuffled by key is at most one row per calendar day.
    """
    present = F.col(date).isNotNull()
    for k in key:
        present = present & F.col(k).isNotNull()
    return (
        df.filter(present).groupBy(*key, date)
        .agg(F.sum(value).alias(value))
    )


def modelling_gate(
    df: DataFrame, key: Sequence[str], value: str = "value", min_rows: int = 30, max_null_share: float = 0.1,
) -> DataFrame:
    """Per key: rows, nulls, whether the series can be modelled, and why not."""
    stats = df.groupBy(*key).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_nulls")
    )
    reason = _gate_reason(F.col("n_rows"), F.col("n_nulls"), min_rows, max_null_share)
    return stats.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")


def _gate_reason(rows: Column, nulls: Column, min_rows: int, max_null_share: float) -> Column:
    return (
        F.when(rows < min_rows, "too_short").when(nulls > rows * max_null_share, "too_many_nulls").otherwise("ok")
    )


def modellable(
    df: DataFrame, key: Sequence[str], value: str = "value", min_rows: int = 30, max_null_share: float = 0.1,
) -> DataFrame:
    """The rows of the series that pass :func:`modelling_gate`.

    Counted over the series, in the shuffle by key that filling and fitting need anyway.
    """
    series = W.partitionBy(*key)
    reason = _gate_reason(
        F.count("*").over(series), F.count_if(F.col(value).isNull()).over(series), min_rows, max_null_share
    )
    return df.withColumn("_reason", reason).filter(F.col("_reason") == "ok").drop("_reason")


def with_min_history(df: DataFrame, key: Sequence[str], min_rows: int = 7) -> DataFrame:
    """Rows of the keys that have at least ``min_rows`` rows."""
    return (
        df.withColumn("_n", F.count("*").over(W.partitionBy(*key)))
        .filter(F.col("_n") >= min_rows).drop("_n")
    )


def recent(df: DataFrame, days: int = 3, date: str = "date", key: Sequence[str] = ()) -> DataFrame:
    """Rows at most ``days`` days older than the latest date, of all rows or of each key."""
    if key:
        latest = F.max(date).over(W.partitionBy(*key))
        return df.withColumn("_latest", latest).filter(
            F.col(date) >= F.date_sub("_latest", days)
        ).drop("_latest")
    latest = df.agg(F.max(date).alias("latest")).scalar()
    return df.filter(F.col(date) >= F.date_sub(latest, days))


def after(df: DataFrame, as_of: dt.date | Column, date: str = "date") -> DataFrame:
    return df.filter(F.col(date) > as_of)


def first_rows(df: DataFrame, key: Sequence[str], n: int, date: str = "date", last: bool = False) -> DataFrame:
    """The first (or last) ``n`` rows of each key by date; pruned before the shuffle."""
    order = F.col(date).desc() if last else F.col(date).asc()
    rank = F.row_number().over(W.partitionBy(*key).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
