"""Small series for tests."""

from __future__ import annotations

import datetime as dt

DAY0 = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return DAY0 + dt.timedelta(days=n)


def series(spark, values, key="a", days=None):
    """One series as ``k, date, value``; ``days`` gives day numbers where they are not 0, 1, 2, ..."""
    days = range(len(values)) if days is None else days
    rows = [(key, day(d), None if v is None else float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "k string, date date, value double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def exchanges(df, kind="hashpartitioning"):
    """How many shuffles of a kind the physical plan has."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum(1 for line in text.splitlines() if f"Exchange {kind}" in line)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
