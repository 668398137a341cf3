"""Passages that occur in several documents, wherever lines end: units cut by content, equal ones found, neighbours joined.

A text's words are cut into units after each word where a sum over the lengths of the last three words says so, unless it
says so for one of the four words before, and after 64 words. So units have five words or more, but for the last of a text
and what is left after 64 words. Where a passage is repeated, the cuts within it are the same, so its whole units are
equal. Units of the same words are copies of each other; those that occur in more than one document are marked, and
marked neighbours are joined to spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, materialise
from . import minhash
from .memory import tidy

#: Weights of the lengths of the last words, the latest first, and what their sum is divided by.
WEIGHTS = (1, 3, 2)
MODULUS = 5
APART = 5
MOST_WORDS = 64
LEAST_WORDS = 20
BYTES_AT_ONCE = 1 << 21
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@cache
def _places(n: int) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text in UTF-8 begin and end, in code points."""
    full = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).astype(np.int8)))
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return point[edge[::2]], point[edge[1::2]]


def unit_starts(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers of the words that begin a unit. ``first`` marks the first words of texts, ``lengths`` are of words in code points."""
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64)
    text = np.cumsum(first)
    total, whole = np.zeros(n, np.int64), np.zeros(n, bool)
    k = len(WEIGHTS)
    for back, weight in enumerate(WEIGHTS):
        total[back:] += weight * lengths[:n - back]
    whole[k - 1:] = text[k - 1:] == text[:n - k + 1]
    said = whole & (total % MODULUS == 0)
    cut = said.copy()
    for back in range(1, APART):
        cut[back:] &= ~(said[:-back] & (text[back:] == text[:-back]))
    begins = first.copy()
    begins[1:] |= cut[:-1]
    starts = np.flatnonzero(begins)
    size = np.diff(np.append(starts, n))
    pieces = -(-size // MOST_WORDS)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + nth * MOST_WORDS


def _units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row, doc, unit, n_words, start, end, hash`` of all units of all texts; ``row`` numbers the rows, ``unit`` a text's units."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                words, begin, end, count = [], [], [], []
                for t in batch.column("__text").to_pylist():
                    own = minhash.words_of(t)
                    a, b = word_places(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8))
                    words += own
                    begin.append(a), end.append(b), count.append(len(own))
                n = np.array(count, np.int64)
                begin, end = np.concatenate([*begin, [0]])[:-1].astype(np.int64), np.concatenate([*end, [0]])[:-1].astype(np.int64)
                first = np.zeros(len(words), bool)
                first[(np.cumsum(n) - n)[n > 0]] = True
                at = unit_starts(end - begin, first)
                size = np.diff(np.append(at, len(words)))
                place = np.arange(len(words)) - np.repeat(at, size)
                mixed = minhash.word_hashes(words) * _places(MOST_WORDS)[place]
                mixed ^= mixed >> np.uint64(29)
                total = np.add.reduceat(mixed * np.uint64(0x9E3779B97F4A7C15), at) if len(at) else np.zeros(0, np.uint64)
                total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD1B54A32D192ED03) + size.astype(np.uint64)
                doc = np.repeat(np.arange(len(n)), n)[at] if len(at) else np.zeros(0, np.int64)
                nth = np.arange(len(at)) - np.searchsorted(doc, doc)
                carried = [batch.column(c).take(pa.array(doc)) for c in ("row", "doc")]
                numbers = [pa.array(x.astype(np.int32)) for x in (nth, size, begin[at], end[at + size - 1])]
                yield pa.RecordBatch.from_arrays([*carried, *numbers, pa.array(total.view(np.int64))], ["row", "doc", "unit", "n_words", "start", "end", "hash"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.col(text).cast("string").alias("__text"))
    schema = f"row long, doc {dict(docs.dtypes)[key]}, unit int, n_words int, start int, end int, hash long"
    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    total, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        yield batch.slice(at, end - at)
        at = end


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The passages that occur in several documents: key, start, end, n_words, class_doc, class_start, occurrences, removed.

    Words are parted by white space and compared in lower case, units by a hash of 64 bits. A passage is a stretch of
    whole units that occur in documents of other keys too, as long as possible, with ``least_words`` words or more; start
    and end are in code points, end exclusive. Units whose first occurrence (by key and place) is elsewhere are removed,
    and a passage is either removed or kept. class_doc, class_start and ``occurrences`` are of the longest unit (the first
    of equal ones).

    A repeated passage is found but for the parts of units at its ends, which have 12 words on average. Null and empty
    texts have no passages. Rows without a key are documents of their own and come last. Repeated rows of one key keep the
    same places. An empty table gives no rows.
    """
    units = materialise(_units(docs, key, text), "units")
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "start")
    others = (F.min("doc") < F.max("doc")) | (F.count_if(F.col("doc").isNull()) > 0) & (F.count("*") > 1)
    # a unit's occurrences are combined before the shuffle, and unique ones end here
    many = units.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n"), others.alias("others")).filter("others")
    found = units.join(many.select("hash", "first", "n"), "hash")
    removed = ~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("start") == F.col("first.start")))
    found = found.select("row", "doc", "unit", "n_words", "start", "end", F.struct(F.col("first.doc").alias("doc"), F.col("first.start").alias("start"), "n").alias("class"), removed.alias("removed"))
    # a text's own units; neighbours differ by one from their number among those found
    number = F.row_number().over(W.partitionBy("row", "removed").orderBy("unit"))
    longest = F.struct(F.col("n_words"), -F.col("unit"))
    joined = found.withColumn("span", F.col("unit") - number).groupBy("row", "removed", "span").agg(
        F.first("doc").alias("__doc"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.max_by("class", longest).alias("class"),
    ).filter(F.col("n_words") >= least_words)
    out = joined.select(F.col("__doc").alias(key), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_words",
                        F.col("class.doc").alias("class_doc"), F.col("class.start").cast("long").alias("class_start"), F.col("class.n").alias("occurrences"), "removed")
    out = materialise(out, "passages")
    discard(units)
    return out
