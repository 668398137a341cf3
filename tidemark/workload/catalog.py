"""All registered queries."""

from . import cleaning, customers, forecasts, series, streams_and_files, climate  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
