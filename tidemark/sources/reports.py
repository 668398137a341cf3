"""Report sink: one folder per part of a report."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import remove
from .tabular import write_table


def _flat(df: DataFrame) -> DataFrame:
    """Without array and map columns, which csv cannot hold."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.drop(*nested)


def write_report(report, path: str, fmt: str = "csv", parts: tuple[str, ...] | None = None) -> list[str]:
    """Write the parts of a report (a dataclass of DataFrames); ``alerts`` only if there are any."""
    written = []
    for field in fields(report):
        if parts is not None and field.name not in parts:
            continue
        part = getattr(report, field.name)
        target, seen = f"{path}/{field.name}", Observation(f"rows of {field.name}")
        counted = (_flat(part) if fmt == "csv" else part).observe(seen, F.count(F.lit(1)).alias("n"))
        write_table(counted, target, fmt)
        if field.name == "alerts" and not seen.get["n"]:
            remove(part.sparkSession, target)
            continue
        written.append(field.name)
    return written
