"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: str = "8", partitions: str = "8", zone: str = "UTC") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", zone).config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        files = path / "*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, "nan") if math.isnan(value) else (2, f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return (3, value.replace(tzinfo=None).isoformat())
    return (4, str(value))


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(_cell(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), rows


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What is not the same, or None."""
    names, got = spark_rows(df)
    other_names, want = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}; only Spark {extra}; only SQL {missing}"
    off = [(g, w) for g, w in zip(got, want) if g != w]
    if off:
        g, w = off[0]
        cells = [(n, a[1], b[1]) for n, a, b in zip(names, g, w) if a != b]
        return f"{len(off)} of {len(got)} rows differ, first in {cells}: {g}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--skip", nargs="*", default=())
    parser.add_argument("--zone", default="UTC")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = args.sf if "/" in args.sf else f"/root/testdata/sf{args.sf}"
    spark, con = session(zone=args.zone), duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        if any(n in name for n in args.skip):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                result = difference(df, con, oracles[name]) or "ok"
            else:
                result = f"rows {df.count()}"
        except Exception as failed:  # the next query is still worth running
            result = f"FAILED {type(failed).__name__}: {str(failed)[:1500]}"
        good = result == "ok" or result.startswith("rows ")
        bad += not good
        print(f"{'  ' if good else '!!'} {name} {time.time() - start:.1f}s {result}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
