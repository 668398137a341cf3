"""Versions of a table, and the keys that differ between two of them without reading the rest.

A version is stored in ranges of hashed keys, beside a tree of content hashes: a leaf for each range, and above that a node
for every sixteen below it. Two versions are compared from the root; only the rows of ranges whose leaves differ are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import as_text

RANGES = 256
FANOUT = 16


def _content(df: DataFrame, columns: Sequence[str]):
    """64 bits of each row's text, to be added up, so that the order of rows doesn't count and copies do."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.xxhash64(F.concat_ws("\x1f", *(as_text(F.col(c), kinds[c]) for c in columns))).cast("decimal(38,0)")


def _levels(ranges: int) -> int:
    n, levels = ranges, 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def store_version(df: DataFrame, path: str, key: Sequence[str], ranges: int = RANGES) -> None:
    """Store the rows below ``path/rows``, by range, and the tree of hashes in ``path/tree``; both replace what is there."""
    columns = df.columns
    placed = df.withColumn("_range", F.pmod(F.xxhash64(*key), F.lit(ranges)).cast("int"))
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # rows of an empty table leave no file to tell it
    spread = placed.hint("rebalance", F.col("_range"))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_range").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    leaves = stored.groupBy("_range").agg(F.count("*").alias("n"), F.sum(_content(stored, columns)).alias("content"))
    tree = leaves.select(F.lit(0).alias("level"), F.col("_range").alias("node"), "n", "content")
    level = tree
    for height in range(1, _levels(ranges) + 1):
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sum("content").alias("content"))
        level = level.select(F.lit(height).alias("level"), "node", "n", "content")
        tree = tree.unionByName(level)
    tree.coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")  # a row for each range and node


def differing_ranges(spark: SparkSession, old: str, new: str) -> list[int]:
    """The ranges whose rows differ between two versions of as many ranges, found from the root down."""
    a, b = (spark.read.parquet(f"{p}/tree") for p in (old, new))
    top = [x.agg(F.max("level")).first()[0] or 0 for x in (a, b)]
    nodes: list[int] | None = None
    for level in range(max(top), -1, -1):
        sides = []
        for x, name in ((a, "old"), (b, "new")):
            own = x.filter(F.col("level") == level)
            if nodes is not None:
                own = own.filter(F.floor(F.col("node") / FANOUT).isin(nodes))
            sides.append(own.select("node", F.struct("n", "content").alias(name)))
        both = sides[0].join(sides[1], "node", "full")
        # at most as many as there are ranges
        nodes = sorted(r.node for r in both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("node").collect())
        if not nodes:
            return []
    return nodes or []


def changed_keys(spark: SparkSession, old: str, new: str, key: Sequence[str]) -> DataFrame:
    """The keys whose rows differ: the key, ``change`` (added, removed, changed), ``old_rows`` and ``new_rows``.

    Only the ranges that differ are read. A key stands for all its rows, in any order; null keys are keys. Versions are to
    have the same columns and number of ranges. Equal versions give no rows.
    """
    ranges = differing_ranges(spark, old, new)
    sides = []
    for path, name in ((old, "old"), (new, "new")):
        rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
        columns = [c for c in rows.columns if c != "_range"]
        rows = rows.filter(F.col("_range").isin(ranges)) if ranges else rows.limit(0)
        sides.append(rows.groupBy(F.struct(*key).alias("_key")).agg(F.count("*").alias(f"{name}_rows"), F.sum(_content(rows, columns)).alias(f"_{name}")))
    both = sides[0].join(sides[1], "_key", "full").filter(~F.col("_old").eqNullSafe(F.col("_new")) | ~F.col("old_rows").eqNullSafe(F.col("new_rows")))
    change = F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").otherwise("changed")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("_key.*", change.alias("change"), count("old_rows"), count("new_rows"))
