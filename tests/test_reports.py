import random

import numpy as np
import pandas as pd
import pytest

from tests.helpers import day, plan_text, series
from tidemark.functions import quantile
from tidemark.functions.quantile import exact_quantiles
from tidemark.operators import reports

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _check(spark, columns, probs=PROBS):
    names = list(columns)
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {(r.column, r.prob): r.quantile for r in exact_quantiles(df, names, probs).collect()}
    for n in names:
        s = pd.Series(columns[n], dtype="float64")
        for p in probs:
            assert got[(n, p)] == pytest.approx(s.quantile(p), rel=1e-12, abs=1e-12), (n, p)


def _columns(n):
    rnd = random.Random(n)
    return {
        "even": [rnd.uniform(-5, 5) for _ in range(n)],
        "heavy": [rnd.paretovariate(0.3) for _ in range(n)],
        "tied": [float(rnd.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "nulls": [None if rnd.random() < 0.3 else rnd.gauss(0, 1) for _ in range(n - 1)] + [0.0],
    }


@pytest.mark.parametrize("n", [1, 2, 5, 7, 1000])
def test_exact_quantiles(spark, n):
    _check(spark, _columns(n))


def test_exact_quantiles_with_many_rows_and_a_middling_sketch(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SKETCH_ACCURACY", 1000)
    _check(spark, _columns(20_000))


def test_numbers_take_two_reads_and_order_few_values(spark, tmp_path):
    spark.range(50_000).selectExpr("cast(id as double) v", "cast(id % 3 as double) w").write.parquet(str(tmp_path / "t"))
    df = reports.describe_numbers(spark.read.parquet(str(tmp_path / "t")))
    rows = {r["column"]: r for r in df.collect()}
    assert (rows["v"].p25, rows["v"].p50, rows["w"].p50, rows["w"]["count"]) == (12499.75, 24999.5, 1.0, 50_000)
    plan = plan_text(df)
    assert plan.split("Initial Plan")[0].count("FileScan") == 2
    empty = {r["column"]: r for r in reports.describe_numbers(spark.read.parquet(str(tmp_path / "t")).limit(0)).collect()}
    assert empty["v"]["count"] == 0 and empty["v"].p50 is None and len(empty) == 2


def test_exact_quantiles_with_a_coarse_sketch(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SKETCH_ACCURACY", 50)
    _check(spark, _columns(5_000))


def test_no_column_comes_together_in_one_task(spark):
    df = spark.range(10).selectExpr("cast(id as double) v")
    text = plan_text(exact_quantiles(df, ["v"], [0.5]))
    assert "percentile(" not in text.replace("percentile_approx(", "")


def test_quality_report(spark):
    df = series(spark, [1, None, 3, 3], days=[0, 1, 2, 2])
    report = reports.quality_report(df)
    assert tuple(report.overview.first()) == (4, 3, 1)
    missing = {r.column: (r.missing, r.missing_percentage, r.data_type) for r in report.columns.collect()}
    assert missing["value"] == (1, 25.0, "double") and missing["k"][0] == 0
    numbers = report.numeric.first()
    s = pd.Series([1, None, 3, 3], dtype="float64").describe()
    np.testing.assert_allclose(
        [numbers["count"], numbers.mean, numbers.std, numbers.min, numbers.p25, numbers.p50, numbers.p75, numbers.max], s
    )
    dates = report.dates.first()
    assert (dates["column"], dates.min, dates.max, dates.range_days) == ("date", "2024-01-01", "2024-01-03", 2)


def test_not_a_number_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (None,)], "v double")
    assert reports.missing_values(df).first().missing == 2
    row = reports.describe_numbers(df).first()
    assert (row["count"], row.mean, row.p50, row.max) == (1, 2.0, 2.0, 2.0)


def test_report_of_text_only(spark):
    report = reports.quality_report(spark.createDataFrame([("x",)], "s string"))
    assert report.numeric.count() == 0 and report.dates.count() == 0


def test_a_column_may_be_called_count(spark):
    df = spark.createDataFrame([(1,), (1,)], "count int")
    assert reports.count_duplicates(df).first().duplicate_rows == 1


def test_profile_takes_the_smaller_of_equally_frequent_values(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4)], "s string, n int")
    row = reports.profile_report(df).filter("column = 's'").first()
    assert (row["count"], row.unique, row.top, row.freq, row.missing, row.missing_percentage) == (4, 2, "a", 2, 1, 20.0)
    approximate = reports.value_profile(df, ["s"], approximate=True).first()
    assert (approximate["count"], approximate.unique) == (4, 2)


def test_main_summary(spark):
    row = reports.main_summary(series(spark, [0, -1, None, 4]), ["k"]).first()
    assert (row.total_records, row.start, row.end) == (4, "2024-01-01", "2024-01-04")
    assert (row.mean, row.median, row.missing_values, row.zero_values, row.negative_values) == (1.0, 0.0, 1, 1, 1)
    assert row["std"] == round(pd.Series([0, -1, 4]).std(), 2)


def test_content_hash_ignores_order_and_sees_copies_and_nulls(spark):
    rows = [("a", day(0), 1.0), ("b", day(1), None)]
    schema = "k string, date date, value double"

    def fingerprint(rs):
        return reports.content_hash(spark.createDataFrame(rs, schema)).first().content_hash

    assert fingerprint(rows) == fingerprint(rows[::-1])
    assert fingerprint(rows) != fingerprint(rows + rows[:1])
    assert fingerprint([("a", day(0), None)]) != fingerprint([(None, day(0), None)])


def test_whole_reports_take_every_column(spark, sf):
    from tidemark.schema import numeric_columns
    from tidemark.workload import catalog
    from tidemark.workload.inputs import climate_full, table

    lineitem, orders, customer = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    for name, want in (("quality_numbers", numeric_columns(lineitem)), ("quality_columns", climate_full(spark, sf).columns),
                       ("profile_report", orders.columns), ("value_profile", customer.columns)):
        assert sorted(r.column for r in catalog.QUERIES[f"{name}_whole"](spark, sf).collect()) == sorted(want)
    whole, repeated = (catalog.QUERIES[f"quality_overview_{x}"](spark, sf).first() for x in ("whole", "repeated"))
    assert whole.total_columns == repeated.total_columns == len(lineitem.columns)
    assert repeated.duplicate_rows - whole.duplicate_rows == lineitem.filter("l_linenumber = 1").count() > 0
