"""Where jobs put files that every executor must see."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def literal_path(path: str) -> str:
    """A pattern that matches this path and no other, for sources that read their path as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, which cuts its lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what :func:`materialise` wrote for ``df``, when nothing that is still to run reads it."""
    path = getattr(df, "_materialised", None)
    if path:
        remove(df.sparkSession, path)
        df._materialised = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that functions of it run there."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(target))
    context._tidemark_shipped = True
