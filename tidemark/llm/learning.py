"""What the classifiers share: a bounded sample of labelled texts, and scoring of every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship
from .memory import tidy


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's text, modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``label, text`` of at most ``most`` labelled documents that ``learn_from`` allows, in an order that hashes the key.

    The bound is on the sample to learn from alone. A key with several labels counts with the least, one with several
    texts with the least; rows without key or label are not learned from.
    """
    ship(docs.sparkSession)
    own = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & learn_from).groupBy(key).agg(F.min(label).alias("label"))
    own = own.orderBy(F.xxhash64(key), key).limit(most).select(F.col(key).alias("__id"), "label")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text"))
    held = texts.join(F.broadcast(own), F.col("__key") == F.col("__id"))  # no more rows than ``most``
    return held.groupBy("__id").agg(F.min("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text")).select("__id", "label", "text")


TEXTS_AT_ONCE = 512


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that what is made from their texts stays small."""
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        yield batch.slice(at, TEXTS_AT_ONCE)


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row. ``score`` gets the whole texts of a batch; a null text is an empty one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                values = score([t or "" for t in batch.column("__text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(values, pa.float64())], [key, "score"])

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, score double")


def kept(docs: DataFrame, score: Callable[[list[str]], np.ndarray], keep: Callable[[np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``keep`` allows by the score of their text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(keep(score(texts)), pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
