"""Typed reads and writes of tabular files; every path is a folder all executors share."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import to_date
from ..storage import literal_path


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", date_columns: Sequence[str] = (),
    date_format: str | None = None, **options,
) -> DataFrame:
    """Read with a stated schema. Date columns are read as text and coerced; a bad date is null."""
    as_text = T.StructType([
        T.StructField(f.name, T.StringType() if f.name in date_columns and fmt != "parquet" else f.dataType)
        for f in schema
    ])
    if fmt == "csv":
        options = {"header": True, **options}
    rows = spark.read.format(fmt).schema(as_text).options(**options).load(path)
    return rows.withColumns({c: to_date(F.col(c), date_format) for c in date_columns})


def read_if_there(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame | None:
    """As :func:`read_table`, or None where the path does not exist."""
    try:
        return read_table(spark, path, schema, **options)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run_name(run_at: dt.datetime | str) -> str:
    """The name of a run: its time, to the microsecond where it has any, or what it is called."""
    return run_at if isinstance(run_at, str) else run_at.strftime("%Y%m%d_%H%M%S" + ("_%f" if run_at.microsecond else ""))


def new_run() -> str:
    """The name of a run that starts now, which no other run gets; names sort by time."""
    return f"{run_name(dt.datetime.now(dt.timezone.utc))}_{uuid.uuid4().hex[:8]}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), run_at: dt.datetime | str | None = None, sort_by: Sequence[str] = ()) -> None:
    """Write, partitioned by a key; a run becomes one more partition column, not a file name.

    ``run_at`` is the time of the run, or its name (see :func:`new_run`). Overwriting a partitioned table replaces the
    partitions that ``df`` has rows for and leaves all others as they are. Rows are rebalanced by the key first: without
    it every task writes a file for every key, and AQE splits a key that holds much more than the others. With
    ``sort_by`` the rows of every file are in that order, after the key.
    """
    if run_at is not None:
        df = df.withColumn("run_ts", F.lit(run_name(run_at)))
        partition_by = [*partition_by, "run_ts"]
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Add rows to a table; what is there is not read or rewritten."""
    write_table(df, path, fmt, "append", partition_by)


def read_sheets(spark: SparkSession, root: str, schemas: dict[str, T.StructType], fmt: str = "csv",
                date_columns: Sequence[str] = ()) -> DataFrame:
    """The tables below ``root``, one folder each, as one relation with a ``sheet`` column."""
    tables = None
    for sheet, schema in schemas.items():
        mine = [c for c in date_columns if c in schema.names]
        one = read_table(spark, f"{root}/{sheet}", schema, fmt, mine).withColumn("sheet", F.lit(sheet))
        tables = one if tables is None else tables.unionByName(one, allowMissingColumns=True)
    return tables


def _files(df: DataFrame) -> DataFrame:
    """``n_files, bytes`` of the files that the scans of ``df`` read, 0 where it reads none."""
    spark, names = df.sparkSession, [unquote(f) for f in df.inputFiles()]
    if not names:
        return spark.range(1).select(F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("bytes"))
    # only the listing is read, not the content
    found = spark.read.format("binaryFile").load([literal_path(f) for f in names])
    return found.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, column names, files and bytes of each table.

    Rows are counted from the table, whatever it is made of. Files are those that its scans read, empty ones included; a
    table that no file holds has none. Without tables there are no rows.
    """
    schema = "sheet string, n_rows long, n_columns int, column_names string, n_files long, bytes long"
    out = SparkSession.active().createDataFrame([], schema) if not tables else None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).join(_files(df).hint("broadcast"), F.lit(True))  # a row each
        one = one.select(F.lit(name).alias("sheet"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
                         F.lit(",".join(df.columns)).alias("column_names"), "n_files", "bytes")
        out = one if out is None else out.unionByName(one)
    return out
