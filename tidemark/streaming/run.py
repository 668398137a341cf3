"""Running a stream over the files that are there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import fresh_path, literal_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """A stream of the files of a table, be it a folder or one file.

    The source takes one file only as a pattern; with the last letter as a class of its own the pattern matches this
    path and no other, whatever signs its name has.
    """
    path = path.rstrip("/")
    last = path[-1] if path[-1] not in "\\]^-" else f"\\{path[-1]}"
    return spark.readStream.format(fmt).schema(schema).load(f"{literal_path(path[:-1])}[{last}]")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available and return what was emitted.

    Output and checkpoint go to the shared folder, so a restarted job goes on where it was.
    """
    return run_counted(stream, name)[0]


def run_counted(stream: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As :func:`run_available`, and how many rows came too late and were left out."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), late


def run_updates(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available in update mode and return every update, with the number of its ``batch``.

    A batch that is run again replaces what it had written.
    """
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(keep).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out)
