import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly, clean, climate
from tidemark.streaming import alerts, rollup
from tidemark.streaming.run import file_stream, run_available, run_counted, run_updates
from tidemark.workload.inputs import readings, readings_of, table

SCHEMA = "customer_id string, ts timestamp, value double"


def _land(spark, folder, batches):
    """One file per micro-batch, in the order of their names."""
    for i, rows in enumerate(batches):
        part = spark.createDataFrame([(c, dt.datetime(2024, 1, d, h), float(v)) for c, d, h, v in rows], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _batch_alerts(df):
    daily = clean.daily_series(df.withColumn("date", F.col("ts").cast("date")), ["customer_id"])
    return {(r.customer_id, r.latest_value, round(r.z_score, 6))
            for r in anomaly.real_time_alerts(daily, per_customer_clock=True).collect()}


def _keys(rows):
    return {(r.customer_id, r.latest_value, round(r.z_score, 6)) for r in rows.collect()}


def _stream_alerts(stream):
    return alerts.current_alerts(run_updates(alerts.daily_verdicts(stream), "alerts"))


def test_alerts_equal_the_batch_on_one_batch(spark, tmp_path):
    rows = [("a", 1, 1, 10), ("a", 2, 1, 11), ("a", 3, 5, 4), ("a", 3, 9, 6), ("a", 4, 1, 40),
            ("b", 1, 1, 10), ("b", 2, 1, 10), ("b", 3, 1, 90), ("c", 1, 1, 1), ("c", 9, 1, 5)]
    out = _stream_alerts(_land(spark, str(tmp_path / "in"), [rows]))
    everything = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in/*"))
    assert _keys(out) == _batch_alerts(everything) and {r.customer_id for r in out.collect()} == {"a"}


def test_alerts_over_several_batches_end_where_the_batch_does(spark, tmp_path):
    batches = [[("a", 1, 1, 10), ("a", 2, 1, 11)], [("a", 3, 1, 10), ("a", 4, 1, 11)], [("a", 5, 1, 20)],
               [("a", 5, 2, 30)], [("a", 4, 9, 0)]]
    out = _stream_alerts(_land(spark, str(tmp_path / "in"), batches))
    # rows of a day add up; the last verdict of a day is the one that holds
    assert [(r.date, r.latest_value) for r in out.collect()] == [(dt.date(2024, 1, 5), 50.0)]
    everything = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in/*"))
    assert _keys(out) == _batch_alerts(everything)


def test_an_alert_is_withdrawn(spark, tmp_path):
    batches = [[("a", 1, 1, 10), ("a", 2, 1, 11), ("a", 3, 1, 30)], [("a", 3, 2, -20)]]
    assert _stream_alerts(_land(spark, str(tmp_path / "in"), batches)).count() == 0


def test_alert_days_are_utc_days_in_any_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        rows = [("a", dt.datetime(2024, 1, d, 20, tzinfo=dt.timezone.utc), float(v)) for d, v in ((1, 10), (2, 11), (3, 40))]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/0"))
        out = _stream_alerts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*")))
        assert [r.date for r in out.collect()] == [dt.date(2024, 1, 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_verdicts_need_no_python_and_add_up_before_the_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], SCHEMA)
    plan = alerts.daily_verdicts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "partial_sum" in plan


def test_a_stream_does_not_read_its_neighbours(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    for name, n in (("t", 3), ("t_old", 5)):
        events.limit(n).write.parquet(str(tmp_path / name))
    assert run_available(file_stream(spark, str(tmp_path / "t"), events.schema), "ids").count() == 3


def test_late_readings_are_counted(spark, tmp_path):
    cols = ("city string, ts timestamp, temperature double, humidity double, pressure double, wind_speed double, "
            "precipitation double, weather_main string, data_source string")
    for i, day in enumerate((1, 5, 6, 1)):
        row = [("c", dt.datetime(2024, 1, day, 1), 1.0, 1.0, 1.0, 1.0, 1.0, "Haze", "x")]
        spark.createDataFrame(row, cols).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out, late = run_counted(rollup.daily_rollup(stream), "rollup")
    assert late == 1 and [(r.weather_main, r.n_readings, r.is_weekend) for r in out.orderBy("date").collect()] == [("Haze", 1, False)]


def test_a_table_may_be_a_folder(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out = run_available(file_stream(spark, str(tmp_path / "events.parquet"), events.schema).select("event_id"), "ids")
    assert out.distinct().count() == events.count()


def test_rollup_equals_the_batch_on_closed_days(spark, sf):
    events = file_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    out = run_available(rollup.daily_rollup(readings_of(events)), "rollup")
    batch = climate.daily_forecast(readings(spark, sf))
    joined = out.alias("s").join(batch.alias("b"), ["city", "date"])
    assert out.count() > 100 and joined.count() == out.count()
    off = joined.filter(
        (F.abs(F.col("s.temperature") - F.col("b.temperature")) > 1e-9) | (F.col("s.weather_main") != F.col("b.weather_main"))
        | (F.abs(F.col("s.precipitation") - F.col("b.precipitation")) > 1e-9)
        | (F.abs(F.col("s.temp_confidence") - F.col("b.temp_confidence")) > 1e-9)
    )
    assert off.count() == 0


@pytest.mark.parametrize("kinds,expected", [
    (["Rain", "Clear"], "Clear"), (["Rain", "Rain", "Clear"], "Rain"), ([None], None), (["Haze", "Rain", "Haze", "Haze"], "Haze")])
def test_rollup_mode(spark, kinds, expected):
    cols = ("city string, ts timestamp, temperature double, humidity double, pressure double, wind_speed double, "
            "precipitation double, weather_main string, data_source string")
    rows = [("c", dt.datetime(2024, 1, 1, i), 1.0, 1.0, 1.0, 1.0, 1.0, k, "x") for i, k in enumerate(kinds)]
    assert rollup.daily_rollup(spark.createDataFrame(rows, cols)).first().weather_main == expected
