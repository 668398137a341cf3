"""Exact statistics of whole columns in two reads, without bringing a column into one task.

``percentile`` keeps every distinct value of a group in one buffer. That is fine for a daily series, whose length the
calendar bounds, and not for a column of a fact table. Here the first read is one aggregate: count, moments, extremes and
a sketch with a known rank error, which puts two edges close around each quantile. The second read counts the values
between the edges of different quantiles and groups those within the edges of one, so that only they, a few in ten
thousand, are put in order. Both are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SKETCH_ACCURACY = 50_000


def _told(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """A row per column from one aggregate: its statistics and, for each quantile, the two sketched edges."""
    margin = 4 / SKETCH_ACCURACY
    cuts = [min(1.0, max(0.0, p + side * margin)) for p in sorted(probs) for side in (-1, 1)]
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
                "edges": lambda c: F.percentile_approx(c, cuts, SKETCH_ACCURACY)}
    wide = df.agg(*[fn(F.col(c).cast("double")).alias(f"{m}{i}") for i, c in enumerate(columns) for m, fn in measures.items()])
    rows = [F.struct(F.lit(c).alias("column"), *(F.col(f"{m}{i}").alias(m) for m in measures)) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def _bin(value: Column, edges: Column, n_edges: int) -> Column:
    """A number that grows with the value: odd within the edges of a quantile, even outside, -1 for null."""
    out = F.lit(n_edges)
    for i in range(n_edges - 1, -1, -1):
        edge = F.get(edges, F.lit(i))
        out = F.when(value < edge if i % 2 == 0 else value <= edge, i).otherwise(out)
    return F.when(value.isNull(), -1).otherwise(out)


def described(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``column, count, mean, std, min, max`` and ``quantiles``, an array by ``probs`` in rising order, of numeric columns.

    Quantiles interpolate linearly between order statistics. Nulls count for nothing; a column without numbers, or of an
    empty table, has count 0 and nulls. A row per column.
    """
    cells = lambda cell: F.inline(F.array(*(F.struct(F.lit(c).alias("column"), cell(c).alias("value")) for c in columns)))
    one = df.sparkSession.range(1).select(cells(lambda c: F.lit(None).cast("double")))  # every column has a cell
    values = df.select(cells(lambda c: F.col(c).cast("double"))).unionByName(one)
    stats = F.struct("count", "mean", "std", "min", "max")
    told = _told(df, columns, probs).select("column", "edges", stats.alias("stats"))
    placed = values.join(F.broadcast(told), "column")  # a row per column
    placed = placed.withColumn("bin", _bin(F.col("value"), F.col("edges"), 2 * len(probs)))
    within = F.when((F.col("bin") >= 0) & (F.col("bin") % 2 == 1), F.col("value"))
    few = placed.groupBy("column", "bin", within.alias("value")).agg(
        F.count("*").alias("n"), F.min(placed.value).alias("least"), F.max(placed.value).alias("most"), F.first("stats").alias("stats"))
    # values within edges, and one row for each stretch between; a rank next to an edge is the stretch's least or most
    upto = F.sum(F.when(F.col("bin") >= 0, F.col("n")).otherwise(0)).over(W.partitionBy("column").orderBy("bin", "value"))
    ordered = few.withColumn("upto", upto)
    at = [F.lit(p) * (F.col("stats.count") - 1) for p in sorted(probs)]

    def first(rank: Column) -> Column:
        """The value of a rank, from the row that holds it: all its values are equal, or the rank is its first or last one."""
        start = F.col("upto") - F.col("n")
        value = F.when(rank == start, F.col("least")).otherwise(F.col("most"))
        return F.min(F.when((start <= rank) & (rank < F.col("upto")), value))

    between = lambda low, high, x: low + (high - low) * (x - F.floor(x))
    found = ordered.groupBy("column", "stats").agg(*(
        first(rank(x)).alias(f"{side}{i}") for i, x in enumerate(at) for side, rank in (("below", F.floor), ("above", F.ceil))))
    quantiles = F.array(*(between(F.col(f"below{i}"), F.col(f"above{i}"), x) for i, x in enumerate(at)))
    return found.select("column", "stats.*", quantiles.alias("quantiles"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, prob, quantile) by linear interpolation between order statistics, of columns that have any value."""
    listed = F.lit([float(p) for p in sorted(probs)])
    rows = described(df, columns, probs).filter("count > 0")
    return rows.select("column", F.inline(F.arrays_zip(listed.alias("prob"), F.col("quantiles").alias("quantile"))))
