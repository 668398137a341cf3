import datetime as dt

import pytest
from pyspark.sql import types as T

from tests.helpers import column, day, series
from tidemark import storage
from tidemark.plans import ingest
from tidemark.schema import MAIN
from tidemark.sources import tabular
from tidemark.storage import literal_path

KV = T.StructType().add("k", "string").add("date", "date").add("value", "double")


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    df = series(spark, [1, None, 3])
    path = str(tmp_path / fmt)
    tabular.write_table(df, path, fmt)
    dates = ["date"] if fmt in ("csv", "json") else []
    back = tabular.read_table(spark, path, KV, fmt, dates)
    assert sorted(back.collect()) == sorted(df.collect())


def test_bad_dates_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿k,date,value\nx,2024-01-01,1\nx,31/12/2024,2\n".encode())
    rows = tabular.read_table(spark, str(tmp_path), KV, date_columns=["date"]).collect()
    assert [(r.k, r.date, r.value) for r in rows] == [("x", day(0), 1.0), ("x", None, 2.0)]


def test_date_format(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,date,value\nx,01/02/2024,1\n")
    row = tabular.read_table(spark, str(tmp_path), KV, date_columns=["date"], date_format="dd/MM/yyyy").first()
    assert row.date == dt.date(2024, 2, 1)


def test_missing_path_is_none(spark, tmp_path):
    assert tabular.read_if_there(spark, str(tmp_path / "nothing"), MAIN) is None


def test_append_adds(spark, tmp_path):
    path = str(tmp_path / "t")
    tabular.append_table(series(spark, [1]), path)
    tabular.append_table(series(spark, [2]), path)
    assert sorted(column(spark.read.parquet(path), "value")) == [1.0, 2.0]


def test_sheets_and_inventory(spark, tmp_path):
    tabular.write_table(series(spark, [1, 2]), str(tmp_path / "one"), "csv")
    tabular.write_table(series(spark, [3]).drop("value"), str(tmp_path / "two"), "csv")
    schemas = {"one": KV, "two": T.StructType.fromDDL("k string, date date")}
    rows = tabular.read_sheets(spark, str(tmp_path), schemas, date_columns=["date"])
    assert sorted((r.sheet, r.value) for r in rows.collect() if r.sheet == "one") == [("one", 1.0), ("one", 2.0)]
    listing = tabular.inventory({"all": rows}).first()
    assert (listing.n_rows, listing.n_columns) == (3, 4)
    found = tabular.inventory({"one": spark.read.schema(KV).csv(str(tmp_path / "one"))}).first()
    assert found.bytes > 0 and found.n_files >= 1


def test_inventory_of_any_relation(spark, tmp_path):
    odd = tmp_path / "a [b] {c} 100%"
    tabular.write_table(series(spark, [1, 2, 3]).coalesce(1), str(odd), "parquet")
    tables = {
        "odd": spark.read.parquet(literal_path(str(odd))), "made": series(spark, [1]), "empty": series(spark, []),
        "twice": spark.read.parquet(literal_path(str(odd))).union(series(spark, [4])),
        "counted": spark.read.parquet(literal_path(str(odd))).groupBy("k").count(),
    }
    found = {r.sheet: (r.n_rows, r.n_columns, r.n_files, r.bytes > 0) for r in tabular.inventory(tables).collect()}
    assert found == {"odd": (3, 3, 1, True), "made": (1, 3, 0, False), "empty": (0, 3, 0, False), "twice": (4, 3, 1, True), "counted": (1, 2, 1, True)}
    assert tabular.inventory({}).count() == 0


def test_two_imports_within_a_second_both_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    for value in (1.0, 2.0):
        raw = spark.createDataFrame([("2024-01-0" + str(d), value, "R") for d in (3, 1, 2)], "date string, value double, region string")
        ingest.store(ingest.import_main(raw), path)
    assert sorted(column(spark.read.parquet(path), "value")) == [1.0] * 3 + [2.0] * 3
    at = dt.datetime(2024, 1, 1, 12, 0, 0, 5)
    assert tabular.run_name(at) == "20240101_120000_000005" and len({tabular.new_run() for _ in range(100)}) == 100
    for _ in range(2):
        ingest.store(ingest.import_main(raw), str(tmp_path / "again"), run_at=at)
    assert spark.read.parquet(str(tmp_path / "again")).count() == 3


def test_rows_of_a_stored_file_are_in_order(spark, tmp_path):
    rows = [(f"2024-{m:02d}-{d:02d}", float(d), f"R{d % 3}") for m in (3, 1, 2) for d in range(28, 0, -1)]
    ingest.store(ingest.import_main(spark.createDataFrame(rows, "date string, value double, region string").repartition(7)), str(tmp_path / "s"))
    files = list((tmp_path / "s").rglob("*.parquet"))
    assert files
    for file in files:
        dates = [r.date for r in spark.read.parquet(str(file)).collect()]
        assert dates == sorted(dates) and dates


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_dir(spark)
    assert folder == named.rstrip("/") if named else folder.startswith("/tmp/run-")
    assert storage.fresh_path(spark, "x") != storage.fresh_path(spark, "x")


def test_materialised_rows_have_no_lineage(spark):
    df = storage.materialise(series(spark, [1, 2]).selectExpr("k", "date", "value * 2 as value"), "t")
    assert sorted(column(df, "value")) == [2.0, 4.0]
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
