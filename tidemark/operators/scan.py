"""Running values over keys that no calendar bounds: raw readings, of which one key may have most.

A key is cut into segments of time (a day, an hour). Each segment is scanned by itself and says little about itself: how
many rows it has, its first and its last known value. Those summaries, a row per segment, are scanned in turn, and what
comes from the segments before and after goes back to the rows. So no task holds a key, only a segment.

Row-bounded windows (lags, rolling statistics, relative changes) need the last rows of the segments before as they are:
:func:`in_segments` gives each segment a copy of them, runs the plain operator, and takes the copies out again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVERY = "day"


def _order(date: str, ties: Sequence[str], descending: bool = False) -> list:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in (date, *ties)]


def segmented(df: DataFrame, key: Sequence[str], date: str = "date", ties: Sequence[str] = (), every: str = EVERY) -> DataFrame:
    """``df`` with ``_id``, the key and the time ``at`` that a row's stretch of ``every`` begins, and ``_at``, its place therein from 1.

    Rows without a time are a segment of their own, before all others, as they come first in any order by time. The id is
    one value, equal also where a part of it is null, so that windows, sums and joins by it share one shuffle.
    """
    own = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key)), F.date_trunc(every, F.col(date)).alias("at"))
    return df.withColumn("_id", own).withColumn("_at", F.row_number().over(W.partitionBy("_id").orderBy(*_order(date, ties))))


def _by_time(key: Sequence[str]):
    """Segments of a key in order, and in reversed order."""
    parts = [F.col("_id")[f"k{i}"] for i in range(len(key))]
    return W.partitionBy(*parts).orderBy(F.col("_id.at").asc_nulls_first()), W.partitionBy(*parts).orderBy(F.col("_id.at").desc_nulls_last())


def _joined(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each row with its segment's summary. The rows stay where they are: the summaries, a row per segment, come to them."""
    return rows.join(summaries.hint("shuffle_hash"), "_id")


def known_around(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], date: str = "date", ties: Sequence[str] = (), every: str = EVERY,
) -> DataFrame:
    """``df`` with ``_pos``, the place in the key's order, and for each column ``_prev_`` and ``_next_``: the (pos, v) of the last known value up to the row, and of the first from it on."""
    rows = segmented(df, key, date, ties, every)
    segment = W.partitionBy("_id")
    back = segment.orderBy(*_order(date, ties)).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = segment.orderBy(*_order(date, ties, descending=True)).rowsBetween(W.unboundedPreceding, W.currentRow)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_at").cast("long").alias("pos"), F.col(c).alias("v"))) for c in columns}
    rows = rows.withColumns({f"_prev_{c}": F.last(known[c], ignorenulls=True).over(back) for c in columns})
    rows = rows.withColumns({f"_next_{c}": F.last(known[c], ignorenulls=True).over(ahead) for c in columns})
    # a row per segment, from the partitioning that the windows have left
    told = rows.groupBy("_id").agg(
        F.count("*").alias("_rows"), *(F.max_by(f"_prev_{c}", "_at").alias(f"_last_{c}") for c in columns),
        *(F.min_by(f"_next_{c}", "_at").alias(f"_first_{c}") for c in columns),
    )
    earlier, later = (w.rowsBetween(W.unboundedPreceding, -1) for w in _by_time(key))
    told = told.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    moved = lambda known: F.when(known.isNotNull(), F.struct((known["pos"] + F.col("_offset")).alias("pos"), known["v"].alias("v")))
    told = told.withColumns({f"_{side}_{c}": moved(F.col(f"_{side}_{c}")) for side in ("last", "first") for c in columns})
    carried = told.select(
        "_id", "_offset", *(F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_before_{c}") for c in columns),
        *(F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_after_{c}") for c in columns),
    )
    out = _joined(rows, carried)
    out = out.withColumns({
        "_pos": F.col("_at") + F.col("_offset"),
        **{f"_prev_{c}": F.coalesce(moved(F.col(f"_prev_{c}")), F.col(f"_before_{c}")) for c in columns},
        **{f"_next_{c}": F.coalesce(moved(F.col(f"_next_{c}")), F.col(f"_after_{c}")) for c in columns},
    })
    return out.drop("_id", "_at", "_offset", *(f"_{side}_{c}" for side in ("before", "after") for c in columns))


def in_segments(
    df: DataFrame, key: Sequence[str], rows_back: int, operator: Callable[[DataFrame, list[str]], DataFrame],
    date: str = "date", ties: Sequence[str] = (), every: str = EVERY,
) -> DataFrame:
    """What ``operator(df, key)`` gives, run on one segment at a time.

    The operator looks back over at most ``rows_back`` rows of its key in the order of ``date`` and ``ties`` and keeps all
    rows and columns. It gets the key and the segment as its key, and before each segment's own rows copies of the
    ``rows_back`` rows that come before them, from as many segments as hold them.
    """
    rows = segmented(df, key, date, ties, every)
    sizes = rows.groupBy("_id").agg(F.count("*").alias("_rows"))
    # every segment has a row at least, so no more than rows_back of them can be near
    following = _by_time(key)[0].rowsBetween(1, max(rows_back, 1))
    coming = F.collect_list(F.struct(F.col("_rows").alias("n"), F.struct(F.col("_id.at").alias("at")).alias("to"))).over(following)
    none = F.array().cast("array<struct<gap:bigint,to:struct<at:timestamp>>>")
    gaps = F.aggregate(coming, F.struct(F.lit(0).cast("long").alias("gap"), none.alias("out")), lambda at, s: F.struct(
        (at["gap"] + s["n"]).alias("gap"), F.concat(at["out"], F.array(F.struct(at["gap"].alias("gap"), s["to"].alias("to")))).alias("out")), lambda at: at["out"])
    near = F.filter(gaps, lambda s: s["gap"] < rows_back)
    placed = _joined(rows, sizes.select("_id", "_rows", near.alias("_coming")))
    copies = F.filter("_coming", lambda s: s["gap"] + F.col("_rows") - F.col("_at") < rows_back)
    own = F.array(F.struct(F.struct(F.col("_id.at").alias("at")).alias("to"), F.lit(False).alias("copy")))
    into = F.concat(own, F.transform(copies, lambda s: F.struct(s["to"].alias("to"), F.lit(True).alias("copy"))))
    spread = placed.withColumn("_into", F.explode(into)).withColumns({"_segment": F.col("_into.to.at"), "_copy": F.col("_into.copy")})
    out = operator(spread.drop("_into", "_id", "_at", "_rows", "_coming"), [*key, "_segment"])
    return out.filter(~F.col("_copy")).drop("_segment", "_copy")
