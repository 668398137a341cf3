"""Summaries, quality and profile reports, content hash, import envelope."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_up, percent_of
from ..functions.quantile import described
from ..schema import date_columns, finite, numeric_columns


def main_summary(df: DataFrame, key: Sequence[str] = ("region",), value: str = "value", date: str = "date") -> DataFrame:
    """Per series of canonical main data: rows, span, statistics to two digits, nulls, zeros, negatives.

    The median is exact; a canonical series has one row per day, which bounds its buffer.
    """
    v = F.col(value)
    return df.groupBy(*key).agg(
        F.count("*").alias("total_records"),
        F.date_format(F.min(date), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max(date), "yyyy-MM-dd").alias("end"),
        half_up(F.avg(v), 2).alias("mean"), half_up(F.stddev_samp(v), 2).alias("std"),
        half_up(F.min(v), 2).alias("min"), half_up(F.max(v), 2).alias("max"),
        half_up(F.percentile(v, 0.5), 2).alias("median"),
        F.count_if(v.isNull()).alias("missing_values"),
        F.count_if(v == 0).alias("zero_values"), F.count_if(v < 0).alias("negative_values"),
    )


def customer_summary_by_region(
    df: DataFrame, customer: str = "customer_id", region: str = "region", value: str = "value",
) -> DataFrame:
    return df.filter(F.col(region).isNotNull()).groupBy(region).agg(
        F.countDistinct(customer).alias("customers"), F.sum(value).alias("total_value")
    )


def customer_summary(
    df: DataFrame, customer: str = "customer_id", region: str = "region", date: str = "date",
) -> DataFrame:
    """Totals over all rows; reduced to customer and region first, so that only those are counted apart."""
    pairs = df.groupBy(customer, region).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    return pairs.agg(
        F.countDistinct(customer).alias("total_customers"), F.countDistinct(region).alias("total_regions"),
        F.date_format(F.min("_first"), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max("_last"), "yyyy-MM-dd").alias("end"),
    )


@dataclass(frozen=True)
class QualityReport:
    """Parts of a data-quality report, one table each."""

    overview: DataFrame   # rows, columns, duplicate rows
    columns: DataFrame    # column, type, missing
    numeric: DataFrame    # column, count, mean, std, min, quartiles, max
    dates: DataFrame      # column, min, max, range in days


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """Measures of each column in one pass, turned into one row per column."""
    wide = df.agg(*[fn(F.col(c)).alias(f"{m}::{c}") for c in columns for m, fn in measures.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{m}::{c}`").alias(m) for m in measures]) for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def _no_rows(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def count_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; copies collapse before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_copies")).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    known = df.select([  # not a number is as missing as null
        F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in types.items()
    ])
    counted = _per_column(known, df.columns, {
        "missing": lambda c: F.count_if(c.isNull()), "total": lambda c: F.count("*"),
    })
    named = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counted.select("column", named[F.col("column")].alias("data_type"), "missing",
                          percent_of(F.col("missing"), F.col("total")).alias("missing_percentage"))


def describe_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the finite numbers of each column, in two reads."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        return _no_rows(df, "column string, count bigint, mean double, std double, min double, p25 double, "
                            "p50 double, p75 double, max double")
    numbers = df.select([finite(F.col(c).cast("double")).alias(c) for c in columns])
    return described(numbers, columns, [0.25, 0.5, 0.75]).select(
        "column", "count", "mean", "std", "min", *(F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(("p25", "p50", "p75"))), "max"
    )


def describe_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or date_columns(df))
    if not columns:
        return _no_rows(df, "column string, min string, max string, range_days int")
    found = _per_column(df, columns, {"_min": lambda c: F.min(c.cast("date")), "_max": lambda c: F.max(c.cast("date"))})
    return found.select(
        "column", F.date_format("_min", "yyyy-MM-dd").alias("min"), F.date_format("_max", "yyyy-MM-dd").alias("max"),
        F.datediff("_max", "_min").alias("range_days"),
    )


def quality_report(df: DataFrame) -> QualityReport:
    return QualityReport(
        overview=count_duplicates(df).select(
            "total_rows", F.lit(len(df.columns)).alias("total_columns"), "duplicate_rows"
        ),
        columns=missing_values(df),
        numeric=describe_numbers(df),
        dates=describe_dates(df),
    )


def value_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: non-null count, distinct values, most frequent value (smallest on a tie) and its count.

    Equal cells are counted before the shuffle; no column is brought together in one task.
    """
    columns = list(columns or df.columns)
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])))
    if approximate:
        return cells.groupBy("column").agg(
            F.count("value").alias("count"), F.approx_count_distinct("value").alias("unique")
        )
    counts = cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"),
    )


def profile_report(df: DataFrame) -> DataFrame:
    """One row per column: type, missing, distinct values, most frequent value, numeric statistics."""
    base = missing_values(df).join(F.broadcast(value_profile(df)), "column", "left")
    numbers = describe_numbers(df).drop("count")
    return base.join(F.broadcast(numbers), "column", "left")  # one row per column each


def as_text(col: Column, dtype: T.DataType, scale: int = 6) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = col.cast(f"decimal(38,{scale})")
    return F.coalesce(col.cast("string"), F.lit("\\N"))


def content_hash(df: DataFrame, key: Sequence[str] = (), scale: int = 6) -> DataFrame:
    """A fingerprint of the rows that does not depend on their order.

    Each row's text is hashed and the first 32 bits are added up, so that copies count.
    Fractions are rendered with ``scale`` digits.
    """
    columns = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(
        F.count("*").alias("n_rows"), F.sum(row_bits(df.select(*columns), scale)).cast("string").alias("content_hash")
    )


def row_bits(df: DataFrame, scale: int = 6) -> Column:
    """32 bits of a hash of the text of a row, over the columns of ``df``."""
    text = F.concat_ws("|", *[as_text(F.col(f.name), f.dataType, scale) for f in df.schema])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")


def import_envelope(
    processed: DataFrame, copies: str, key: Sequence[str] = ("region",), date: str = "date", scale: int = 6,
) -> DataFrame:
    """What an import reports: rows read and kept, distinct keys, date span, content hash.

    ``copies`` holds how many rows each kept row stands for, so the input is not read again.
    Rows are reduced to one per key combination first; only those are counted apart.
    """
    by_key = processed.groupBy(*key).agg(
        F.sum(copies).alias("_read"), F.count("*").alias("_kept"), F.min(date).alias("_first"),
        F.max(date).alias("_last"), F.sum(row_bits(processed.drop(copies), scale)).alias("_bits"),
    )
    return by_key.agg(
        F.sum("_read").alias("original_rows"), F.sum("_kept").alias("processed_rows"),
        *[F.countDistinct(k).alias({"region": "regions", "customer_id": "customers"}.get(k, k)) for k in key],
        F.date_format(F.min("_first"), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max("_last"), "yyyy-MM-dd").alias("end"),
        F.sum("_bits").cast("string").alias("content_hash"),
    )
