"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``covers`` names the inventory rows it shows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = exact_rounding(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded half up, after noise in the last digits of a double is gone."""
    return df.withColumns({c: F.round(F.round(c, max(8, digits)), digits) for c in columns})


def half_up(expr: str, digits: int) -> str:
    """The same in SQL, by way of a decimal: DuckDB multiplies a double first, which may move an exact half."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def exact_rounding(sql: str) -> str:
    """Every ``ROUND(expression, digits)`` that is not over a decimal yet, by :func:`half_up`."""
    out, at = "", 0
    while (start := sql.find("ROUND(", at)) >= 0:
        end, depth = start + len("ROUND("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, _, digits = sql[start + len("ROUND("):end - 1].rpartition(",")
        inner = exact_rounding(inner)
        plain = "AS DECIMAL(30,8))" in inner[-len("AS DECIMAL(30,8))"):] or int(digits) >= 8
        out += sql[at:start] + (f"ROUND({inner},{digits})" if plain else half_up(inner, int(digits)))
        at = end
    return out + sql[at:]


def sql_with(*ctes: str, body: str) -> str:
    """``WITH`` the given ``name AS (...)`` texts, followed by the body."""
    return "WITH " + ",\n".join(ctes) + "\n" + body
