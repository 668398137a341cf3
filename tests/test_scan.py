"""Scans by segments against the plain windows over whole keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import features, fill, scan

START = dt.datetime(2024, 1, 1)


def _readings(spark, seed, n=600, minutes=6000, keys="aaab"):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        gap = lambda share, v: None if rnd.random() < share else v
        rows.append((rnd.choice(keys), START + dt.timedelta(minutes=rnd.randrange(minutes)), i, gap(0.7, round(rnd.gauss(0, 5), 3)), gap(0.95, rnd.random()), gap(0.6, f"t{i}")))
    rows += [("empty", START, n, None, None, None), ("one", START, n + 1, 1.5, None, "x"), (None, START, n + 2, 2.0, None, None), (None, START + dt.timedelta(days=3), n + 3, None, 1.0, "y")]
    return spark.createDataFrame(rows, "k string, ts timestamp, seq int, v double, w double, kind string")


def _same(a, b, digits=9):
    cell = lambda x: round(x, digits) if isinstance(x, float) else x
    get = lambda df: sorted((tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert sorted(a.columns) == sorted(b.columns) and get(a) == get(b)


@pytest.mark.parametrize("every", ["day", "hour", "minute", "year"])
def test_fills_equal_the_plain_windows(spark, every):
    df = _readings(spark, 1)
    for fn, columns in ((fill.linear_fill, ["v", "w"]), (fill.interpolate, ["v", "w"]), (fill.carry_forward, ["kind", "v"])):
        _same(fn(df, ["k"], columns, "ts", ["seq"], every), fn(df, ["k"], columns, "ts", ["seq"]))
    _same(fill.repair_observations(df, ["k"], ["v", "w"], ["kind"], "ts", ["seq"], every), fill.repair_observations(df, ["k"], ["v", "w"], ["kind"], "ts", ["seq"]))


@pytest.mark.parametrize("every, rows_back", [("day", 6), ("hour", 6), ("minute", 6), ("minute", 30), ("day", 1)])
def test_windows_over_rows_equal_the_plain_ones(spark, every, rows_back):
    df = _readings(spark, 2, 400)

    def lagged(rows, key):
        w = W.partitionBy(*key).orderBy("ts", "seq")
        return rows.withColumns({
            "far": F.lag("v", rows_back).over(w), "near": F.lag("kind", 1).over(w), "mean": F.avg("v").over(w.rowsBetween(-rows_back, 0)),
            "change": F.col("v") - F.lag("v", 1).over(w)})

    _same(scan.in_segments(df, ["k"], rows_back, lagged, "ts", ["seq"], every), lagged(df, ["k"]))


def test_registered_features_run_in_segments(spark):
    df = _readings(spark, 3, 300).withColumn("at", F.struct("ts", "seq"))
    rolling = lambda rows, key: features.add_rolling(features.add_lags(rows, key, "v", (1, 3), "at"), key, "v", (3, 5), ("mean", "min"), "at")
    _same(scan.in_segments(df, ["k"], 4, rolling, "ts", ["seq"], "hour").drop("at"), rolling(df, ["k"]).drop("at"))


def test_rows_without_a_time_come_first(spark):
    df = spark.createDataFrame([("a", None, 1, 7.0), ("a", START, 2, None), ("a", None, 3, None), ("a", START + dt.timedelta(days=2), 4, None)], "k string, ts timestamp, seq int, v double")
    _same(fill.carry_forward(df, ["k"], ["v"], "ts", ["seq"], "day"), fill.carry_forward(df, ["k"], ["v"], "ts", ["seq"]))
    assert [r.v for r in fill.carry_forward(df, ["k"], ["v"], "ts", ["seq"], "day").collect()] == [7.0] * 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, seq int, v double")
    assert fill.linear_fill(df, ["k"], ["v"], "ts", ["seq"], "day").count() == 0
    assert scan.in_segments(df, ["k"], 3, lambda rows, key: rows, "ts", ["seq"]).count() == 0


def test_a_key_with_most_rows_is_spread(spark):
    n = 400_000
    hot = F.when(F.rand(3) < 0.6, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 40).cast("string")))
    df = spark.range(n).select(hot.alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.when(F.col("id") % 7 == 0, F.rand(4)).alias("v"))
    rows = lambda out: sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.sum("v")).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = rows(fill.carry_forward(df, ["k"], ["v"], "ts", every="hour"))
        whole = rows(fill.carry_forward(df, ["k"], ["v"], "ts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(spread) == n and spread[-1] <= 2 * spread[len(spread) // 2]
    assert whole[-1] > 0.6 * n
