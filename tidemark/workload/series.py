"""Gap filling, repair, calendar, lag, rolling and sequence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import features, fill, scan
from ..plans import modelling
from .inputs import (
    KEY, ctes, cust_events, cust_orders, event_regions, holed, nulled, holiday_dates, readings, region_daily, climate_daily,
)
from .registry import half_up, query, rounded, sql_with


def _round_sql(columns, digits=4) -> str:
    return ", ".join(f"{half_up(c, digits)} AS {c}" for c in columns)


def interpolate_sql(name: str, src: str, key: str, columns: list[str], lead: bool, rest: str = "") -> str:
    """CTE ``name``: ``src`` with the columns interpolated by position, then the last value, then the first."""
    parts, outs = [], []
    for c in columns:
        parts.append(f"""
           LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS pp_{c},
           LAST_VALUE({c} IGNORE NULLS) OVER back AS pv_{c},
           LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS np_{c},
           LAST_VALUE({c} IGNORE NULLS) OVER ahead AS nv_{c}""")
        tail = f", nv_{c}" if lead else ""
        outs.append(
            f"COALESCE({c}, pv_{c} + (nv_{c} - pv_{c}) * (CAST(pos - pp_{c} AS DOUBLE) / (np_{c} - pp_{c})), pv_{c}{tail}) AS {c}"
        )
    dropped = ", ".join(f"{p}_{c}" for c in columns for p in ("pp", "pv", "np", "nv"))
    return f"""{name} AS (
    SELECT * EXCLUDE (pos, {dropped}) REPLACE ({', '.join(outs)}) {rest} FROM (
        SELECT *, {','.join(parts)}
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY date) AS pos FROM {src})
        WINDOW back AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               ahead AS (PARTITION BY {key} ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def spine_sql(name: str, src: str, key: str) -> str:
    return f"""{name} AS (
    SELECT {key}, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT {key}, MIN(date) AS first_day, MAX(date) AS last_day FROM {src} GROUP BY {key}))"""


def outlier_sql(name: str, src: str, key: str) -> str:
    return f"""{name} AS (
    SELECT * EXCLUDE (q1, med, q3) REPLACE (
           CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN med ELSE value END AS value)
    FROM (SELECT *, QUANTILE_CONT(value, 0.25) OVER s AS q1, QUANTILE_CONT(value, 0.5) OVER s AS med,
                 QUANTILE_CONT(value, 0.75) OVER s AS q3 FROM {src} WINDOW s AS (PARTITION BY {key})))"""


CALENDAR_SQL = """isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, month(date) AS month,
           quarter(date) AS quarter, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend"""
CYCLE_SQL = """SIN(2 * PI() * dayofyear(date) / 365.25) AS day_sin, COS(2 * PI() * dayofyear(date) / 365.25) AS day_cos,
           SIN(2 * PI() * (isodow(date) - 1) / 7) AS week_sin, COS(2 * PI() * (isodow(date) - 1) / 7) AS week_cos"""


def lag_sql(key: str, lags) -> str:
    return ", ".join(f"LAG(value, {n}) OVER (PARTITION BY {key} ORDER BY date) AS lag_{n}" for n in lags)


def rolling_sql(key: str, windows, stats) -> str:
    fn = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX"}
    out = []
    for n in windows:
        frame = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out += [f"CASE WHEN COUNT(value) {frame} = {n} THEN {fn[s]}(value) {frame} END AS rolling_{s}_{n}" for s in stats]
    return ", ".join(out)


@query("linear_fill", "G1", sql_with(
    ctes("nulled"), interpolate_sql("filled", "nulled", "customer_id", ["value"], True),
    body=f"SELECT customer_id, region, date, {half_up('value', 4)} AS value FROM filled"))
def linear_fill(spark, sf_dir):
    return rounded(fill.linear_fill(nulled(spark, sf_dir), KEY, ["value"]), 4, "value")


@query("repaired_observations", "G2", sql_with(
    ctes("climate_daily"), interpolate_sql("filled", "climate_daily", "city", ["temperature", "humidity"], False),
    body=f"""SELECT city, date, {_round_sql(['temperature', 'humidity'])}, weather_main
            FROM (SELECT * REPLACE (LAST_VALUE(CASE WHEN day(date) % 3 <> 0 THEN weather_main END IGNORE NULLS) OVER (
                      PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weather_main)
                  FROM filled)"""))
def repaired_observations(spark, sf_dir):
    rows = climate_daily(spark, sf_dir).withColumn(
        "weather_main", F.when(F.dayofmonth("date") % 3 != 0, F.col("weather_main"))
    )
    out = fill.repair_observations(rows, ["city"], ["temperature", "humidity"], ["weather_main"])
    return rounded(out, 4, "temperature", "humidity").select("city", "date", "temperature", "humidity", "weather_main")


FILLED_MEAN = "COALESCE(value, AVG(value) OVER (PARTITION BY customer_id))"


@query("interpolated_or_mean", "G3", sql_with(
    ctes("nulled"), interpolate_sql("filled", "nulled", "customer_id", ["value"], False),
    body=f"""SELECT customer_id, date, {half_up(FILLED_MEAN, 4)} AS value FROM filled"""))
def interpolated_or_mean(spark, sf_dir):
    return rounded(fill.interpolate_or_mean(nulled(spark, sf_dir), KEY, "value"), 4, "value").drop("region")


@query("carried_or_zero", "G4", sql_with(ctes("nulled"), body="""
    SELECT customer_id, date, COALESCE(LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS value FROM nulled"""))
def carried_or_zero(spark, sf_dir):
    return fill.carry_then_zero(nulled(spark, sf_dir), KEY, ["value"]).drop("region")


CARRIED = """carried AS (
    SELECT customer_id, date, LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM nulled),
counted AS (SELECT *, COUNT(*) OVER s - COUNT(value) OVER s AS n_missing FROM carried WINDOW s AS (PARTITION BY customer_id))"""


@query("carried_complete_series", "G5", sql_with(
    ctes("nulled"), CARRIED, body="SELECT customer_id, date, value FROM counted WHERE n_missing = 0"))
def carried_complete_series(spark, sf_dir):
    return fill.carry_forward_or_reject(nulled(spark, sf_dir), KEY, "value")[0].drop("region")


@query("carried_rejected_series", "G5", sql_with(ctes("nulled"), CARRIED, body="""
    SELECT customer_id, MAX(n_missing) AS n_missing FROM counted WHERE n_missing > 0 GROUP BY customer_id"""))
def carried_rejected_series(spark, sf_dir):
    return fill.carry_forward_or_reject(nulled(spark, sf_dir), KEY, "value")[1]


@query("outliers_to_median", "G6 W7", sql_with(
    ctes("region_daily"), outlier_sql("repaired", "region_daily", "region"),
    body=f"SELECT region, date, {half_up('value', 4)} AS value FROM repaired"))
def outliers_to_median(spark, sf_dir):
    return rounded(fill.outliers_to_median(region_daily(spark, sf_dir), ["region"]), 4, "value")


@query("daily_spine", "J3 D4", sql_with(
    ctes("region_daily"), spine_sql("spine", "region_daily", "region"), body="SELECT region, date FROM spine"))
def daily_spine(spark, sf_dir):
    return fill.daily_spine(region_daily(spark, sf_dir), ["region"])


@query("on_daily_spine", "J3", sql_with(
    ctes("holed"), spine_sql("spine", "holed", "customer_id"),
    body="SELECT customer_id, date, region, value FROM spine LEFT JOIN holed USING (customer_id, date)"))
def on_daily_spine(spark, sf_dir):
    return fill.on_daily_spine(holed(spark, sf_dir), KEY)


@query("daily_continuity", "G7 J3 G1", sql_with(
    ctes("region_daily"), spine_sql("spine", "region_daily", "region"),
    "spread AS (SELECT region, date, value FROM spine LEFT JOIN region_daily USING (region, date))",
    interpolate_sql("filled", "spread", "region", ["value"], True),
    body=f"SELECT region, date, {half_up('value', 4)} AS value FROM filled"))
def daily_continuity(spark, sf_dir):
    return rounded(fill.daily_continuity(region_daily(spark, sf_dir), ["region"]), 4, "value")


def _modelling_sql(src: str, key: str) -> str:
    return ",\n".join([
        interpolate_sql("filled", src, key, ["value"], True), outlier_sql("repaired", "filled", key),
        spine_sql("spine", "repaired", key),
        f"spread AS (SELECT {key}, date, value FROM spine LEFT JOIN repaired USING ({key}, date))",
        interpolate_sql("daily", "spread", key, ["value"], True),
        f"table_rows AS (SELECT *, {CALENDAR_SQL}, {lag_sql(key, (1, 2, 3, 7))}, "
        f"{rolling_sql(key, (7, 14, 30), ('mean', 'std'))} FROM daily)",
    ])


_MODELLING_ROUNDED = ["value", *[f"lag_{n}" for n in (1, 2, 3, 7)],
                      *[f"rolling_{s}_{n}" for n in (7, 14, 30) for s in ("mean", "std")]]


@query("modelling_table", "G8 G1 G6 G7 D1 W1 W2", sql_with(
    ctes("region_daily"), _modelling_sql("region_daily", "region"),
    body=f"SELECT * REPLACE ({_round_sql(_MODELLING_ROUNDED)}) FROM table_rows"))
def modelling_table(spark, sf_dir):
    return rounded(fill.modelling_table(region_daily(spark, sf_dir), ["region"]), 4, *_MODELLING_ROUNDED)


@query("modelling_table_with_gaps", "G8", sql_with(
    ctes("holed"), "gappy AS (SELECT customer_id, date, value FROM holed)", _modelling_sql("gappy", "customer_id"),
    body=f"SELECT * REPLACE ({_round_sql(_MODELLING_ROUNDED)}) FROM table_rows"))
def modelling_table_with_gaps(spark, sf_dir):
    rows = modelling.modelling_data(holed(spark, sf_dir).drop("region"), KEY)
    return rounded(rows, 4, *_MODELLING_ROUNDED)


@query("forecast_input", "G9 G3 D2", sql_with(
    ctes("nulled"), interpolate_sql("filled", "nulled", "customer_id", ["value"], False), body=f"""
    SELECT customer_id, date, {half_up(FILLED_MEAN, 4)} AS value,
           year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) - 1 AS dayofweek,
           dayofyear(date) AS dayofyear, quarter(date) AS quarter FROM filled"""))
def forecast_input(spark, sf_dir):
    return rounded(fill.forecast_input(nulled(spark, sf_dir), KEY), 4, "value").drop("region")


@query("numbered_days", "G9", sql_with(ctes("cust_events"), body="""
    SELECT customer_id, value, datediff('day', DATE '2024-01-01', date) AS seq,
           DATE '2020-01-01' + CAST(ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS INTEGER) AS date
    FROM cust_events"""))
def numbered_days(spark, sf_dir):
    undated = cust_events(spark, sf_dir).select(
        "customer_id", "value", F.datediff("date", F.lit("2024-01-01").cast("date")).alias("seq")
    )
    return fill.number_days(undated, KEY, "seq")


@query("calendar_columns", "D1 D3", sql_with(ctes("region_daily"), body=f"""
    SELECT region, date, {CALENDAR_SQL}, {', '.join(f'ROUND({x.split(" AS ")[0]}, 6) AS {x.split(" AS ")[1]}'
                                                   for x in CYCLE_SQL.replace(chr(10), ' ').split(', '))}
    FROM region_daily"""))
def calendar_columns(spark, sf_dir):
    rows = calendar.with_cycles(calendar.with_calendar(region_daily(spark, sf_dir)))
    return rounded(rows, 6, "day_sin", "day_cos", "week_sin", "week_cos").drop("value")


@query("date_parts", "D2", sql_with(ctes("region_daily"), body="""
    SELECT region, date, year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) - 1 AS dayofweek,
           dayofyear(date) AS dayofyear, quarter(date) AS quarter FROM region_daily"""))
def date_parts(spark, sf_dir):
    return calendar.with_date_parts(region_daily(spark, sf_dir)).drop("value")


@query("lags", "W1 W3", sql_with(ctes("cust_orders"), body=f"""
    SELECT customer_id, date, value, {lag_sql('customer_id', features.MODEL_LAGS)} FROM cust_orders"""))
def lags(spark, sf_dir):
    return features.add_lags(cust_orders(spark, sf_dir), KEY, "value", features.MODEL_LAGS).drop("region")


_ROLLED = [f"rolling_{s}_{n}" for n in features.MODEL_WINDOWS for s in ("mean", "std", "min", "max")]


@query("rolling_statistics", "W2 W4", sql_with(
    ctes("cust_events"),
    f"""rolled AS (SELECT customer_id, date,
        {rolling_sql('customer_id', features.MODEL_WINDOWS, ('mean', 'std', 'min', 'max'))} FROM cust_events)""",
    body=f"SELECT customer_id, date, {_round_sql(_ROLLED)} FROM rolled"))
def rolling_statistics(spark, sf_dir):
    rows = cust_events(spark, sf_dir)
    out = features.add_rolling(rows, KEY, "value", features.MODEL_WINDOWS, ("mean", "std", "min", "max"))
    return rounded(out, 4, *_ROLLED).drop("region", "value")


@query("trend", "W5", sql_with(ctes("region_daily"), body="""
    SELECT region, date, value, rn AS trend, rn * rn AS trend_squared FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY date) - 1 AS rn FROM region_daily)"""))
def trend(spark, sf_dir):
    return features.add_trend(region_daily(spark, sf_dir), ["region"])


@query("sequence_windows", "W14 AR1", sql_with(
    ctes("cust_events"), "numbered AS (SELECT *, " + lag_sql("customer_id", range(1, 8)) +
    ", ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) AS rn FROM cust_events)", body="""
    SELECT customer_id, date, value AS target, lag_7 AS x0, lag_6 AS x1, lag_5 AS x2, lag_4 AS x3, lag_3 AS x4,
           lag_2 AS x5, lag_1 AS x6 FROM numbered WHERE rn > 7"""))
def sequence_windows(spark, sf_dir):
    out = features.sequence_windows(cust_events(spark, sf_dir), KEY)
    return out.select("customer_id", "date", "target", *[F.col("inputs")[i].alias(f"x{i}") for i in range(7)])


@query("holiday_flags", "J6", sql_with(ctes("event_regions", "holiday_dates"), body="""
    SELECT region, date, value, CAST(date IN (SELECT date FROM holiday_dates) AS INTEGER) AS is_holiday
    FROM event_regions"""))
def holiday_flags(spark, sf_dir):
    return features.flag_dates(event_regions(spark, sf_dir), holiday_dates(spark, sf_dir))


RESAMPLED = """resampled AS (
    SELECT city, date, temperature, humidity, pressure, wind_speed, COALESCE(precipitation, 0) AS precipitation
    FROM spine LEFT JOIN (
        SELECT city, date, AVG(temperature) AS temperature, AVG(humidity) AS humidity, AVG(pressure) AS pressure,
               AVG(wind_speed) AS wind_speed, COALESCE(SUM(precipitation), 0) AS precipitation
        FROM climate_daily GROUP BY city, date) USING (city, date))"""


@query("resampled_climate", "A10 J3", sql_with(
    ctes("climate_daily"), spine_sql("spine", "climate_daily", "city"), RESAMPLED, body=f"""
    SELECT city, date, {_round_sql(['temperature', 'humidity', 'pressure', 'wind_speed'])},
           {half_up('precipitation', 2)} AS precipitation FROM resampled"""))
def resampled_climate(spark, sf_dir):
    out = features.resample_climate(climate_daily(spark, sf_dir), ["city"])
    return rounded(rounded(out, 4, "temperature", "humidity", "pressure", "wind_speed"), 2, "precipitation")


CITY_SERIES = """city_series AS (
    SELECT city, date, ROUND(SUM(temperature), 2) AS value FROM readings GROUP BY city, date)"""


def city_series(spark, sf_dir):
    """A business value per city and day, on all days."""
    return readings(spark, sf_dir).groupBy("city", "date").agg(F.round(F.sum("temperature"), 2).alias("value"))


_CLIMATE_FILLED = ", ".join(
    f"""COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER back, LAST_VALUE({c} IGNORE NULLS) OVER ahead) AS weather_{c}"""
    for c in features.CLIMATE_MEASURES)
ALIGNED = f"""aligned AS (
    SELECT city, date, value, {_CLIMATE_FILLED}
    FROM city_series LEFT JOIN resampled USING (city, date)
    WINDOW back AS (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           ahead AS (PARTITION BY city ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_CLIMATE_NAMES = [f"weather_{c}" for c in features.CLIMATE_MEASURES]


@query("climate_features", "R2 J4 A10", sql_with(
    ctes("climate_daily"), CITY_SERIES, spine_sql("spine", "climate_daily", "city"), RESAMPLED, ALIGNED,
    body=f"SELECT city, date, value, {_round_sql(_CLIMATE_NAMES)} FROM aligned"))
def climate_features(spark, sf_dir):
    out = features.align_climate(city_series(spark, sf_dir), climate_daily(spark, sf_dir), ["city"])
    return rounded(out, 4, *_CLIMATE_NAMES)


_FEATURES = [
    "day_of_week", "day_of_month", "month", "quarter", "is_weekend", "is_holiday",
    "day_sin", "day_cos", "week_sin", "week_cos", *[f"lag_{n}" for n in features.MODEL_LAGS], *_ROLLED,
    *_CLIMATE_NAMES, "trend", "trend_squared",
]


@query("feature_table", "R1 G4 W3 W4 W5 D1 D3", sql_with(
    ctes("climate_daily", "holiday_dates"), CITY_SERIES, spine_sql("spine", "climate_daily", "city"), RESAMPLED, ALIGNED,
    f"""raw_features AS (
    SELECT *, {CALENDAR_SQL}, CAST(date IN (SELECT date FROM holiday_dates) AS INTEGER) AS is_holiday, {CYCLE_SQL},
           {lag_sql('city', features.MODEL_LAGS)},
           {rolling_sql('city', features.MODEL_WINDOWS, ('mean', 'std', 'min', 'max'))},
           ROW_NUMBER() OVER (PARTITION BY city ORDER BY date) - 1 AS trend,
           (ROW_NUMBER() OVER (PARTITION BY city ORDER BY date) - 1)
           * (ROW_NUMBER() OVER (PARTITION BY city ORDER BY date) - 1) AS trend_squared
    FROM aligned)""",
    body="SELECT city, date, value, " + ", ".join(
        half_up(f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER back, 0)", 4) + f" AS {c}" for c in _FEATURES
    ) + """ FROM raw_features
    WINDOW back AS (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def feature_table(spark, sf_dir):
    out = features.feature_table(
        city_series(spark, sf_dir), ["city"], climate=climate_daily(spark, sf_dir), holidays=holiday_dates(spark, sf_dir)
    )
    return rounded(out, 4, *_FEATURES)


RAW_READINGS = """raw_readings AS (
    SELECT city, event_id, CASE WHEN event_id % 5 <> 0 THEN temperature END AS temperature,
           CASE WHEN event_id % 3 = 1 THEN humidity END AS humidity, CASE WHEN event_id % 4 = 0 THEN weather_main END AS kind,
           ROW_NUMBER() OVER (PARTITION BY city ORDER BY ts, event_id) AS date FROM readings)"""


def raw_readings(spark, sf_dir):
    """Single readings of each city, with holes; nothing bounds how many a city has."""
    part = F.col("event_id")
    return readings(spark, sf_dir).select(
        "city", "event_id", "ts", F.when(part % 5 != 0, F.col("temperature")).alias("temperature"),
        F.when(part % 3 == 1, F.col("humidity")).alias("humidity"), F.when(part % 4 == 0, F.col("weather_main")).alias("kind"))


@query("segmented_observations", "G1 G2", sql_with(
    ctes("readings"), RAW_READINGS, interpolate_sql("repaired", "raw_readings", "city", ["temperature", "humidity"], False), body="""
    SELECT city, event_id, ROUND(temperature, 4) AS temperature, ROUND(humidity, 4) AS humidity,
           LAST_VALUE(kind IGNORE NULLS) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind
    FROM repaired"""))
def segmented_observations(spark, sf_dir):
    out = fill.repair_observations(raw_readings(spark, sf_dir), ["city"], ["temperature", "humidity"], ["kind"], "ts", ["event_id"], every="day")
    return rounded(out, 4, "temperature", "humidity").drop("ts")


@query("segmented_changes", "W1 W2 W8 W10", sql_with(ctes("readings"), RAW_READINGS, body="""
    SELECT city, event_id, LAG(temperature, 1) OVER w AS lag_1, LAG(temperature, 7) OVER w AS lag_7,
           CASE WHEN COUNT(temperature) OVER f = 5 THEN ROUND(AVG(temperature) OVER f, 4) END AS rolling_mean_5,
           CASE WHEN COUNT(temperature) OVER f = 5 THEN MAX(temperature) OVER f END AS rolling_max_5
    FROM raw_readings WINDOW w AS (PARTITION BY city ORDER BY date),
         f AS (PARTITION BY city ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""))
def segmented_changes(spark, sf_dir):
    rows = raw_readings(spark, sf_dir).select("city", "event_id", F.struct("ts", "event_id").alias("at"), "ts", "temperature")

    def changes(part, key):
        lagged = features.add_lags(part, key, "temperature", (1, 7), "at")
        return features.add_rolling(lagged, key, "temperature", (5,), ("mean", "max"), "at")

    out = scan.in_segments(rows, ["city"], 7, changes, "ts", ["event_id"], every="day")
    return rounded(out, 4, "rolling_mean_5").drop("at", "ts", "temperature")
