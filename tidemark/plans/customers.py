"""Customer analysis from raw rows to a stored report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators.clean import daily_series
from ..operators.anomaly import AnomalyReport, Thresholds, analyse_customers
from ..sources.reports import write_report
from ..storage import materialise
from .ingest import import_customers


def analyse(raw: DataFrame, customer: str = "customer_id", date: str = "date", value: str = "value",
            region: str = "region", sequence: str | None = None, limits: Thresholds = Thresholds(),
            analysed_at: dt.datetime | None = None) -> AnomalyReport:
    """Canonical rows, added up to one per customer, region and day, then the analysis.

    However many raw rows a customer has, what is shuffled by customer is bounded by the days.
    The canonical rows feed every part of the report and are written once to the shared folder.
    """
    rows = import_customers(raw, customer, date, value, region, sequence).rows
    rows = materialise(daily_series(rows, ["customer_id", "region"]), "customers")
    return analyse_customers(rows, limits=limits, analysed_at=analysed_at)


def export(report: AnomalyReport, path: str, fmt: str = "csv") -> list[str]:
    """Summary, ranking, regions and, if there are any, alerts; one folder each."""
    return write_report(report, path, fmt, ("summary", "top_customers", "regions", "alerts"))
