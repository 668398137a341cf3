"""Versions of a table and the keys that differ."""

import random

from tests.helpers import day
from tidemark.sources import versions


def _rows(n):
    rnd = random.Random(1)
    return [(f"k{i % (n // 4)}", day(i % 40), round(rnd.gauss(0, 1), 3) if i % 9 else None) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k string, date date, v double")


def _changes(spark, old, new):
    return {r.k: (r.change, r.old_rows, r.new_rows) for r in versions.changed_keys(spark, old, new, ["k"]).collect()}


def test_one_changed_row_reads_one_range(spark, tmp_path):
    rows = _rows(800)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    versions.store_version(_frame(spark, rows), old, ["k"], 64)
    other = [r if i != 17 else (r[0], r[1], 99.0) for i, r in enumerate(rows)]
    versions.store_version(_frame(spark, other[::-1]), new, ["k"], 64)
    assert len(versions.differing_ranges(spark, old, new)) == 1
    found = versions.changed_keys(spark, old, new, ["k"])
    assert {(r.k, r.change, r.old_rows, r.new_rows) for r in found.collect()} == {(rows[17][0], "changed", 4, 4)}
    assert "PartitionFilters: [_range" in found._jdf.queryExecution().executedPlan().toString().replace("isnotnull(_range#", "_range")
    reached = sum(spark.read.parquet(f"{p}/rows").filter(f"_range = {versions.differing_ranges(spark, old, new)[0]}").count() for p in (old, new))
    assert reached < 2 * 800 / 8


def test_added_removed_copies_and_null_keys(spark, tmp_path):
    rows = [*_rows(80), (None, day(0), 1.0), ("gone", day(1), 2.0), ("twice", day(1), 3.0), ("twice", day(1), 3.0)]
    other = [r for r in rows if r[0] != "gone"][:-1] + [("here", day(2), None), (None, day(0), 2.0)]
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    versions.store_version(_frame(spark, rows), old, ["k"], 8)
    versions.store_version(_frame(spark, other).repartition(3), new, ["k"], 8)
    assert _changes(spark, old, new) == {"gone": ("removed", 1, 0), "here": ("added", 0, 1), "twice": ("changed", 2, 1), None: ("changed", 1, 2)}
    assert _changes(spark, old, old) == {}


def test_empty_versions(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    versions.store_version(_frame(spark, _rows(16)), old, ["k"], 4)
    versions.store_version(_frame(spark, []), new, ["k"], 4)
    assert {c for c, _, _ in _changes(spark, old, new).values()} == {"removed"} and len(_changes(spark, old, new)) == 4
