import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day, exchanges, series
from tidemark.operators import clean
from tidemark.plans import ingest
from tidemark.schema import check_columns, finite, to_number


def test_not_a_number_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(finite(F.col("v"))).collect()] == [None, None, None, 1.5, None]


def test_text_is_coerced(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(to_number(F.col("v"))).collect()] == [1.5, None, None, None, None]


def test_canonical_main_takes_custom_names_and_a_constant_region(spark):
    raw = spark.createDataFrame([("2024-01-02", "7"), ("2024-02-30", "x")], "day string, amount string")
    rows = clean.canonical_main(raw, "day", "amount", F.lit("north")).collect()
    assert [tuple(r) for r in rows] == [("north", dt.date(2024, 1, 2), 7.0), ("north", None, None)]


def test_missing_customer_stays_null_and_leaves_group_operators(spark):
    raw = spark.createDataFrame([(None, "2024-01-01", "1", "r"), ("a", "2024-01-01", "2", "r")],
                                "customer_id string, date string, value string, region string")
    rows = clean.canonical_customers(raw)
    assert rows.filter("customer_id is null").count() == 1
    assert [r.customer_id for r in clean.daily_series(rows, ["customer_id"]).collect()] == ["a"]


def test_keep_first_by_sequence(spark):
    df = spark.createDataFrame([("r", day(0), 5.0, 2), ("r", day(0), 7.0, 1), ("r", day(1), 1.0, None), ("r", day(1), 2.0, 9)],
                               "region string, date date, value double, seq long")
    out = clean.keep_first(df, ["region", "date"], "seq", "n")
    assert sorted((r.date, r.value, r.n) for r in out.collect()) == [(day(0), 7.0, 2), (day(1), 2.0, 2)]
    assert out.columns == ["region", "date", "value", "seq", "n"]


def test_keep_first_without_sequence_prefers_smaller_and_known(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 3, "z"), ("a", 3, "y")], "k string, n int, s string")
    assert [tuple(r) for r in clean.keep_first(df, ["k"]).collect()] == [("a", 3, "y")]


def test_keep_first_with_text_order(spark):
    df = spark.createDataFrame([("a", "q", 1, 2.0), ("a", "p", 3, 4.0)], "k string, o string, n int, v double")
    assert [tuple(r) for r in clean.keep_first(df, ["k"], "o").collect()] == [("a", "p", 3, 4.0)]


def test_copies_collapse_before_the_shuffle(spark):
    df = series(spark, range(10))
    text = clean.keep_first(df, ["k", "date"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in text and "Window" not in text


@pytest.mark.parametrize("values,reason", [
    ([1.0] * 29, "too_short"), ([1.0] * 30, "ok"), ([None] * 4 + [1.0] * 27, "too_many_nulls"),
    ([None] * 3 + [1.0] * 27, "ok"), ([None] * 40, "too_many_nulls"),
])
def test_modelling_gate(spark, values, reason):
    df = series(spark, values)
    row = clean.modelling_gate(df, ["k"]).first()
    assert (row.reason, row.valid) == (reason, reason == "ok")
    assert clean.modellable(df, ["k"]).count() == (len(values) if reason == "ok" else 0)


@pytest.mark.parametrize("n,kept", [(6, 0), (7, 7), (8, 8)])
def test_min_history(spark, n, kept):
    assert clean.with_min_history(series(spark, range(n)), ["k"]).count() == kept


def test_recent_is_inclusive(spark):
    df = series(spark, range(10))
    assert column(clean.recent(df, 3), "value") == [6.0, 7.0, 8.0, 9.0]
    two = df.unionByName(series(spark, [1, 2], "b"))
    assert clean.recent(two, 3).filter("k = 'b'").count() == 0
    assert clean.recent(two, 3, key=["k"]).filter("k = 'b'").count() == 2


def test_head_tail_and_future(spark):
    df = series(spark, range(10))
    assert column(clean.first_rows(df, ["k"], 2), "value") == [0.0, 1.0]
    assert column(clean.first_rows(df, ["k"], 2, last=True), "value") == [8.0, 9.0]
    assert column(clean.after(df, F.lit(day(7))), "value") == [8.0, 9.0]


def test_schema_check(spark):
    df = series(spark, [1])
    assert check_columns(df, ["date", "value"])["is_valid"]
    assert check_columns(df, ["date", "amount"])["missing_columns"] == ["amount"]


def test_import_main_needs_its_columns(spark):
    with pytest.raises(ValueError, match="amount"):
        ingest.import_main(series(spark, [1]), value="amount")


def test_import_counts_rows_read_and_kept(spark):
    raw = spark.createDataFrame([("r", "2024-01-01", 1.0), ("r", "2024-01-01", 2.0), ("s", "2024-01-05", 3.0)],
                                "region string, date string, value double")
    row = ingest.import_main(raw).envelope.first()
    assert (row.original_rows, row.processed_rows, row.regions, row.start, row.end) == (3, 2, 2, "2024-01-01", "2024-01-05")


def test_stored_import_reports_from_the_write(spark, tmp_path):
    raw = spark.createDataFrame([("r", "2024-01-01", 1.0), ("r", "2024-01-01", 2.0)], "region string, date string, value double")
    seen = ingest.store(ingest.import_main(raw), str(tmp_path / "main"), run_at=dt.datetime(2024, 1, 2))
    assert (seen["original_rows"], seen["processed_rows"]) == (2, 1)
    assert seen["content_hash"] == ingest.import_main(raw).envelope.first().content_hash
    assert (tmp_path / "main" / "region=r" / "run_ts=20240102_000000").is_dir()


def test_daily_series_needs_one_shuffle(spark):
    assert exchanges(clean.daily_series(series(spark, range(5)), ["k"])) == 1
