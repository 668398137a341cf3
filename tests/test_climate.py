import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day
from tidemark.functions import climate as rules
from tidemark.operators import climate
from tidemark.schema import CLIMATE
from tidemark.sources import payloads, snapshots


def _obs(spark, rows):
    return spark.createDataFrame(rows, "city string, date date, temperature double, humidity double, pressure double")


def test_standard_columns_from_aliases(spark):
    raw = spark.createDataFrame([("c", day(0), 1.0, 2.0, 3.0)],
                                "city string, date date, temperature_2m double, cloudcover double, humidity double")
    row = climate.standardise(raw, "open").first()
    assert row.asDict() == {"city": "c", "date": day(0), "temperature": 1.0, "humidity": 3.0, "pressure": None,
                            "wind_speed": None, "precipitation": None, "cloud_cover": 2.0, "is_holiday": None,
                            "is_weekend": None, "data_source": "open"}
    assert climate.standardise(raw, "open").schema.names == CLIMATE.names


def test_vocabulary(spark):
    df = spark.createDataFrame([("Rain", 0.0), ("Haze", 6.0), (None, 3.0)], "m string, p double")
    rows = df.select(rules.describe(F.col("m")), rules.precipitation_icon(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("雨天", "dry"), ("Haze", "wet"), (None, "mixed")]


@pytest.mark.parametrize("t,h,p,rain,kind", [
    (1, 50, 1013, 6, "Rain"), (0, 50, 1013, 6, "Snow"), (9, 81, 1009, 5, "Clouds"), (9, 39, 1021, 0, "Clear"),
    (9, 80, 1009, 0, None),
])
def test_rules(spark, t, h, p, rain, kind):
    df = spark.createDataFrame([(float(t), float(h), float(p), float(rain))], "t double, h double, p double, r double")
    assert df.select(rules.classify(*[F.col(c) for c in "thpr"])).first()[0] == kind


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(5.0,), (99.0,), (None,)], "humidity double")
    assert [r[0] for r in df.select(rules.clip_measure("humidity")).collect()] == [20.0, 95.0, None]


def test_first_relation_wins(spark):
    a = _obs(spark, [("c", day(0), 1.0, None, None), ("c", day(1), None, None, None)])
    b = _obs(spark, [("c", day(1), 5.0, 5.0, 5.0), ("c", day(2), 6.0, 6.0, 6.0)])
    assert column(climate.union_preferring(a, b), "temperature") == [1.0, None, 6.0]
    over = climate.fail_over(a, b, ["temperature"])
    assert column(over, "temperature") == [1.0, None, 6.0]
    assert column(over, "data_source") == ["primary", "primary", "secondary"]


def test_horizon(spark):
    assert [climate.split_horizon(n) for n in (1, 3, 7)] == [(1, 1), (3, 1), (3, 4)]
    a = _obs(spark, [("c", day(i), 1.0, 1.0, 1.0) for i in range(20)])
    b = _obs(spark, [("c", day(i), 2.0, 2.0, 2.0) for i in range(20)])
    got = climate.horizon(a, b, day(10), 7)
    assert column(got, "date") == [day(i) for i in range(8, 15)]
    assert column(got, "temperature") == [1.0] * 3 + [2.0] * 4


def test_compare_has_days_of_either(spark):
    a, b = _obs(spark, [("c", day(0), 1.0, 1.0, 1.0)]), _obs(spark, [("c", day(1), 2.0, 2.0, 2.0)])
    assert column(climate.compare_sources(a, b), "temperature_diff") == [None, None]
    assert climate.overlap_days(a, b).count() == 0


def test_enrichment_keeps_rows_and_fills_within_the_region(spark):
    main = spark.createDataFrame([(r, day(i), 1.0) for r in ("r", "s") for i in range(3)], "region string, date date, value double")
    obs = spark.createDataFrame([("r", day(0), 10.0), ("r", day(2), 20.0)], "region string, date date, temperature double")
    out = climate.enrich(main, obs)
    assert out.count() == 6
    assert column(out.filter("region = 'r'"), "temperature") == [10.0, 15.0, 20.0]
    assert column(out.filter("region = 's'"), "temperature") == [None] * 3


def test_daily_forecast(spark):
    cols = ("city string, date date, temperature double, humidity double, pressure double, wind_speed double, "
            "precipitation double, weather_main string, data_source string")
    rows = [("c", day(5), 10.0, 50.0, 1000.0, 1.0, 1.0, "Rain", "api"), ("c", day(5), 12.0, None, 1002.0, 3.0, 2.0, "Clear", "api"),
            ("c", day(6), 1.0, 5.0, 1.0, 1.0, 0.0, None, "api"), ("c", day(6), 1.0, 5.0, 1.0, 1.0, 0.0, "Mist", "sim")]
    one, two = climate.daily_forecast(spark.createDataFrame(rows, cols)).orderBy("date").collect()
    assert (one.temperature, one.humidity, one.precipitation, one.weather_main, one.data_source) == (11.0, 50.0, 3.0, "Clear", "api")
    assert (one.temp_confidence, one.is_weekend, two.data_source, two.weather_main, two.temp_confidence) == (90.0, True, "mixed", "Mist", 95.0)


def test_summaries(spark):
    cols = ("city string, date date, temperature double, humidity double, pressure double, wind_speed double, "
            "precipitation double, weather_main string, is_holiday boolean, is_weekend boolean")
    rows = [("c", day(0), 10.0, None, 1.0, 1.0, 0.0, "Rain", True, False), ("c", day(1), 11.0, 50.0, 1.0, 2.0, 2.0, "Rain", False, True)]
    df = spark.createDataFrame(rows, cols)
    s = climate.climate_summary(df).first()
    assert (s.total_days, s.rainy_days, s.precipitation_total, s.data_completeness) == (2, 1, 2.0, 0.5)
    c = climate.city_summary(df).first()
    assert (c.weather_types, c.holidays, c.weekends, c.data_quality) == ({"Rain": 2}, 1, 1, 95)


def test_regions_of_cities(spark):
    cities = climate.region_cities(spark)
    assert cities.count() == 10 and {r.timezone for r in cities.collect()} == {"Asia/Shanghai"}
    cols = "city string, date date, temperature double, humidity double, pressure double, wind_speed double, precipitation double"
    w = spark.createDataFrame([("广州", day(0), 10.0, 1.0, 1.0, 1.0, 1.0), ("深圳", day(0), 20.0, 1.0, 1.0, 1.0, 2.0)], cols)
    row = climate.by_region(w, cities).first()
    assert (row.region, row.temperature, row.precipitation) == ("广东", 15.0, 3.0)


def test_readings_are_dated_in_the_zone_of_their_city(spark):
    doc = '{"list": [{"dt": 1704139200, "main": {"temp": 1}}]}'  # 20:00 UTC of the first day
    zones = spark.createDataFrame([("a", "Asia/Shanghai")], "city string, timezone string")
    holidays = spark.createDataFrame([(day(1),)], "date date")
    rows = payloads.parse_readings(_documents(spark, [("a", doc), ("b", doc)]), zones=zones, holidays=holidays)[0]
    assert [(r.city, r.date, r.is_holiday) for r in rows.orderBy("city").collect()] == [("a", day(1), True), ("b", day(0), False)]


def test_enrichment_does_not_depend_on_the_order_of_rows(spark):
    main = [("r", day(i), float(v)) for i in range(3) for v in (1, 2)]
    obs = spark.createDataFrame([("r", day(0), 10.0), ("r", day(2), 20.0)], "region string, date date, temperature double")
    for rows in (main, main[::-1]):
        out = climate.enrich(spark.createDataFrame(rows, "region string, date date, value double"), obs)
        assert sorted((r.date, r.temperature) for r in out.collect()) == [(day(i), 10.0 + 5 * i) for i in range(3) for _ in range(2)]


def _documents(spark, rows):
    return spark.createDataFrame(rows, "city string, payload string")


def test_daily_payload(spark):
    good = '{"daily": {"time": ["2024-01-01", "bad"], "temperature_2m_max": [5, 6], "temperature_2m_min": [1.5, null], "precipitation_sum": [0]}}'
    rows, rejects = payloads.parse_daily(_documents(spark, [("a", good), ("b", "{}"), ("c", "oops"), ("d", None)]))
    got = [tuple(r) for r in rows.collect()]
    assert got == [("a", day(0), 5.0, 1.5, 0.0, "historical"), ("a", None, 6.0, None, None, "historical")]
    assert sorted(r.city for r in rejects.collect()) == ["b", "c", "d"]


def test_reading_payload(spark):
    doc = ('{"list": [{"dt": 1704067200, "main": {"temp": 1.5, "humidity": 2, "pressure": 3}, "wind": {"speed": 4},'
           ' "weather": [{"main": "Rain", "description": "x"}, {"main": "Fog", "description": "y"}]},'
           ' {"dt": 1704585600, "main": {"temp": 1}, "rain": {"3h": 0.5}, "weather": []}]}')
    rows, rejects = payloads.parse_readings(_documents(spark, [("a", doc), ("b", '{"cod": 401}')]))
    one, two = rows.orderBy("ts").collect()
    assert (one.date, one.precipitation, one.weather_main, one.is_weekend) == (day(0), 0.0, "Rain", False)
    assert (two.precipitation, two.weather_main, two.is_weekend, two.pressure) == (0.5, None, True, None)
    assert [r.city for r in rejects.collect()] == ["b"]


def test_city_hits(spark):
    hit = '{"results": [{"latitude": 1, "longitude": 2}, {"name": "z", "latitude": 3, "longitude": 4}]}'
    rows = payloads.parse_city_hits(_documents(spark, [("a", hit), ("b", '{"results": []}'), ("c", "{}")])).orderBy("city").collect()
    assert tuple(rows[0]) == ("a", "a", 1.0, 2.0, "Asia/Shanghai")
    assert [tuple(r)[1:] for r in rows[1:]] == [(None,) * 4] * 2


def test_landed_folder_with_whole_files(spark, tmp_path):
    (tmp_path / "city=gz").mkdir()
    (tmp_path / "city=gz" / "a.json").write_text('{"daily":\n {"time": ["2024-01-01"]}}')
    rows, _ = payloads.parse_daily(payloads.read_payloads(spark, str(tmp_path), whole_files=True))
    assert [(r.city, r.date) for r in rows.collect()] == [("gz", day(0))]


def test_snapshot_expires(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = climate.standardise(_obs(spark, [("c", day(i), 1.0, 1.0, 1.0) for i in range(5)]), "a")
    snapshots.save_snapshot(rows, path, "a")
    now = dt.datetime.now()
    load = snapshots.load_snapshot(spark, path, "a", ["c"], day(1), day(3), now=now + dt.timedelta(days=7, hours=1))
    assert load.count() == 3 and load.columns == CLIMATE.names
    assert snapshots.load_snapshot(spark, path, "a", now=now + dt.timedelta(days=8, hours=1)).count() == 0
    assert snapshots.load_snapshot(spark, path, "b").count() == 0


def test_snapshot_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "snap")
    snapshots.save_snapshot(climate.standardise(_obs(spark, [("c", day(0), 1.0, 1.0, 1.0)]), "a"), path, "a")
    text = snapshots.load_snapshot(spark, path, "a", ["c"], day(0), day(1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(provider" in text and "GreaterThanOrEqual(date" in text
