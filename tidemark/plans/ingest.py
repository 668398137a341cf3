"""Importing main and customer data: read, canonical columns, one row per key, summary, store."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import clean, reports
from ..schema import check_columns, to_instant
from ..sources.tabular import new_run, write_table


COPIES = "_copies"
_AT = "_at"


@dataclass(frozen=True)
class Import:
    """A cleaned relation with its summary and envelope; all lazy."""

    rows: DataFrame
    summary: DataFrame
    envelope: DataFrame
    counted: DataFrame  # the rows and how many raw rows each stands for


def _require(df: DataFrame, columns: list[str]) -> None:
    check = check_columns(df, columns)
    if not check["is_valid"]:
        raise ValueError(f"missing columns {check['missing_columns']}, there are {check['available_columns']}")


def _dated(kept: DataFrame, key: list[str]) -> DataFrame:
    return kept.select(*key, F.to_date(_AT).alias("date"), "value", COPIES)


def import_main(raw: DataFrame, date: str = "date", value: str = "value", region: str | Column = "region",
                sequence: str | None = None) -> Import:
    """One row per region and time, the first by ``sequence``; ``date`` is the day of it.

    Rows of one day at other times are not copies of each other. ``clean.daily_series`` adds them up, as a step of its own.
    """
    _require(raw, [date, value])
    extra = [sequence] if sequence else []
    canonical = clean.canonical_main(raw, date, value, region, [*extra, to_instant(F.col(date)).alias(_AT)]).drop("date")
    kept = _dated(clean.keep_first(canonical, ["region", _AT], sequence, COPIES), ["region"])
    rows = kept.drop(COPIES)
    return Import(rows, reports.main_summary(rows), reports.import_envelope(kept, COPIES), kept)


def import_customers(raw: DataFrame, customer: str = "customer_id", date: str = "date", value: str = "value",
                     region: str = "region", sequence: str | None = None) -> Import:
    """One row per customer, region and time, the first by ``sequence``; see :func:`import_main` for the days."""
    _require(raw, [customer, date, value, region])
    extra = [sequence] if sequence else []
    canonical = clean.canonical_customers(raw, customer, date, value, region, [*extra, to_instant(F.col(date)).alias(_AT)]).drop("date")
    kept = _dated(clean.keep_first(canonical, ["customer_id", _AT, "region"], sequence, COPIES), ["customer_id", "region"])
    rows = kept.drop(COPIES)
    envelope = reports.import_envelope(kept, COPIES, ["customer_id", "region"])
    return Import(rows, reports.customer_summary_by_region(rows), envelope, kept)


def store(imported: Import, path: str, fmt: str = "parquet", run_at: dt.datetime | str | None = None) -> dict:
    """Add the cleaned rows to a store, by region and run; other runs and regions stay as they are.

    A run gets a name of its own, so two imports never share one, however close they are. Storing a run of the same
    ``run_at`` (a time or a name) again replaces its regions. The rows of every file are in order of date and key. Rows
    read and kept, date span and content hash come from the write itself, not a second pass.
    """
    seen = Observation("import")
    observed = imported.counted.observe(
        seen, F.sum(COPIES).alias("original_rows"), F.count(F.lit(1)).alias("processed_rows"),
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.sum(reports.row_bits(imported.rows)).cast("string").alias("content_hash"),
    )
    order = [c for c in ("date", "customer_id") if c in imported.rows.columns]
    write_table(observed.drop(COPIES), path, fmt, partition_by=["region"], run_at=run_at or new_run(), sort_by=order)
    return seen.get
