"""Climate snapshots: parquet by provider and city, valid for some days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLIMATE

VALID_DAYS = 7


def save_snapshot(climate: DataFrame, path: str, provider: str) -> None:
    """Add a provider's rows and when they were saved; what was saved earlier for the same days is no longer read."""
    saved = climate.drop("provider").withColumns({"provider": F.lit(provider), "saved_at": F.current_timestamp()})
    (
        saved.hint("rebalance", F.col("city"))
        .write.mode("append").partitionBy("provider", "city").parquet(path)
    )


def load_snapshot(
    spark: SparkSession, path: str, provider: str, cities: Sequence[str] | None = None,
    start: dt.date | None = None, end: dt.date | None = None, valid_days: int = VALID_DAYS,
    now: dt.datetime | None = None,
) -> DataFrame:
    """The newest saved row of each city and day, from files no older than ``valid_days``.

    Provider, city and dates are pruned or pushed down. Rows of a city and day collapse before the shuffle.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CLIMATE)}, provider string, saved_at timestamp"
    rows = spark.read.schema(schema).parquet(path).filter(F.col("provider") == provider)
    if cities is not None:
        rows = rows.filter(F.col("city").isin(list(cities)))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end))
    when = F.current_timestamp() if now is None else F.lit(now)
    # whole days of age count, so a file is valid until one day after its last valid day
    oldest = when - F.make_dt_interval(F.lit(valid_days + 1))
    rows = rows.filter(F.col("_metadata.file_modification_time") > oldest)
    rest = [c for c in CLIMATE.names if c not in ("city", "date")]
    # of rows saved at the same moment the greatest, so the choice does not depend on their order
    newest = F.max(F.struct("saved_at", F.struct(*rest).alias("row")))["row"].alias("row")
    found = rows.groupBy("city", "date").agg(newest)
    return found.select("city", "date", "row.*").select(*CLIMATE.names)
