"""What each filter removes in every order of five filters, with copies found behind a counting Bloom sketch.

1. One pass over the texts writes slim rows: key, part, the failed text filters as bits, and the text's SHA-256.
2. Each task counts the hashes of its rows in the cells of a counting Bloom sketch; counts are "once" and "more", so
   sketches merge by page in a plain aggregate. A text with a cell that nothing else has met is unique for certain.
3. Only the texts that may repeat are shuffled, whole, copies combined before, for the least key of each equal text.
4. The slim rows learn from these keys whether they are the first, join the labels, and are counted by part and mask.
   All 120 orders are sums over the 32 masks of a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise, ship
from .words import bound, words_of

FILTERS = "ABCDE"
BITS = {letter: 1 << i for i, letter in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PROBES = 4
CELLS_A_ROW = 16
LEAST_CELLS = 1 << 16
MOST_CELLS = 1 << 28
PAGE = 1 << 13


def failed_text_filters(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    def counted(words: Column) -> Column:
        n = F.size(words)
        few = F.when(n < 200, BITS["A"]).otherwise(0)
        return few + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, BITS["B"]).otherwise(0)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        bound(words_of(text), counted) + F.when(100 * capitals > 2 * F.length(text), BITS["C"]).otherwise(0)
        + F.when(F.regexp_like(text, F.lit("[#$%&*|]")), BITS["D"]).otherwise(0)
    )


def cells_for(rows: int, most: int = MOST_CELLS) -> int:
    """A power of two of about 16 cells a row, within the bounds."""
    return min(most, max(LEAST_CELLS, 1 << math.ceil(math.log2(max(1, rows * CELLS_A_ROW)))))


def _cells(digests: np.ndarray, cells: int) -> np.ndarray:
    """A row of cells for each SHA-256: its first four 32-bit words."""
    return digests[:, :4 * PROBES].copy().view("<u4") & np.uint32(cells - 1)


def _as_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 32)


def repeat_sketch(slim: DataFrame, cells: int) -> bytes:
    """A bit for each cell: whether two rows or more of ``slim`` (with a column digest) have met it.

    A text's own cells count once a row. Tasks send the cells they met, by pages; the merge of a page is a byte for each cell.
    """
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # cells that one text has twice count once
            own = np.sort(_cells(_as_rows(batch.column("digest")), cells), axis=1)
            first = np.ones(own.shape, bool)
            first[:, 1:] = own[:, 1:] != own[:, :-1]
            cell, n = np.unique(own[first], return_counts=True)
            page, edge = np.unique(cell // PAGE, return_index=True)
            edge = np.append(edge, len(cell))
            for name, keep in (("once", n == 1), ("more", n > 1)):
                parts = [(cell[a:b][keep[a:b]] % PAGE).astype("<u2").tobytes() for a, b in zip(edge[:-1], edge[1:])]
                kind = pa.array([name] * len(page))
                yield pa.RecordBatch.from_arrays([pa.array(page.astype(np.int32)), kind, pa.array(parts, pa.binary())], ["page", "kind", "at"])

    def merged(pages: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PAGE, np.int64)
        for kind, at in zip(pages["kind"], pages["at"]):
            # places within one row are distinct
            total[np.frombuffer(at, "<u2")] += 1 if kind == "once" else 2
        return pd.DataFrame({"page": [pages["page"].iloc[0]], "bits": [np.packbits(total > 1, bitorder="little").tobytes()]})

    parts = slim.select("digest").mapInArrow(met, "page int, kind string, at binary")
    whole = bytearray(cells // 8)
    # as many rows as the sketch has pages, whatever the table holds
    for row in parts.groupBy("page").applyInPandas(merged, "page int, bits binary").toLocalIterator():
        whole[row["page"] * PAGE // 8:(row["page"] + 1) * PAGE // 8] = row["bits"]
    return bytes(whole)


def may_repeat(spark, sketch: bytes):
    """A function of a digest column: whether the sketch allows that another row has the same text."""
    held = spark.sparkContext.broadcast(sketch)
    cells = 8 * len(sketch)

    @F.arrow_udf("boolean")
    def test(digests: pa.Array) -> pa.Array:
        if not len(digests):
            return pa.array([], pa.bool_())
        at = _cells(_as_rows(digests), cells)
        bits = np.frombuffer(held.value, np.uint8)
        return pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

    return test


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def masks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source", most_cells: int = MOST_CELLS) -> DataFrame:
    """``__id, part, mask`` of every row of ``docs``: the bits of the filters that it fails."""
    spark = docs.sparkSession
    ship(spark)
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own.alias("__text"))
    slim = source.select("__id", "part", failed_text_filters(F.col("__text")).alias("bits"), _digest(F.col("__text")).alias("digest"))
    slim = materialise(slim, "slim")
    repeats = may_repeat(spark, repeat_sketch(slim, cells_for(slim.count(), most_cells)))
    possible = source.filter(F.col("__id").isNotNull()).withColumn("__digest", _digest(F.col("__text"))).filter(repeats("__digest"))
    # whole texts are compared; equal ones of a task become one before the shuffle
    first = possible.groupBy("__text").agg(F.min("__id").alias("__first")).select("__first", _digest(F.col("__text")).alias("__digest"))
    first = materialise(first, "first")
    rows = slim.withColumn("possible", repeats("digest") & F.col("__id").isNotNull())
    # the keys of firsts are as many as texts, so this join has no hot key however many copies a text has
    known = (F.col("__id") == F.col("__first")) & (F.col("digest") == F.col("__digest"))
    copy = F.col("possible") & F.col("__first").isNull()
    out = rows.join(first, known, "left").select("__id", "part", (F.col("bits") + F.when(copy, BITS["E"]).otherwise(0)).alias("mask"))
    out = materialise(out, "masks")
    for done in (slim, first):
        discard(done)
    return out


def _step(counts: Column, before: Column, letter: Column) -> dict[str, Column]:
    """The counts of one step. ``counts`` has a struct (n, good, toxic) for each mask, ``before`` the bits of the filters that came first."""
    def total(field: str, chosen) -> Column:
        some = F.transform(counts, lambda c, mask: F.when(chosen(mask), c[field]).otherwise(F.lit(0)))
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, b: a + b)

    fails = lambda mask: mask.bitwiseAND(letter) != 0
    fresh = lambda mask: mask.bitwiseAND(before) == 0
    removed = lambda mask: fails(mask) & fresh(mask)
    # in 1 of k of all orders a filter comes first among the k that a document fails
    of_orders = lambda c, mask: F.when(fails(mask), c["n"] * (len(ORDERS) / F.bit_count(mask)).cast("long")).otherwise(F.lit(0))
    return {
        "kept": total("n", lambda mask: fresh(mask) & ~fails(mask)), "removed": total("n", removed),
        "redundant": total("n", lambda mask: fails(mask) & ~fresh(mask)), "unique_fails": total("n", lambda mask: mask == letter),
        "good_lost": total("good", removed), "toxic_lost": total("toxic", removed),
        "shapley": F.aggregate(F.transform(counts, of_orders), F.lit(0).cast("long"), lambda a, b: a + b),
    }


def audit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source", most_cells: int = MOST_CELLS,
) -> DataFrame:
    """A row per part, order of the filters A to E and step: what the step's filter removes and keeps of the part's documents.

    Filters (a document fails): A under 200 words; B distinct words less than half; C capitals over 2 per cent of the code
    points; D any of ``#$%&*|``; E the same text as a row of a smaller key, anywhere in the table, removed or not. Columns:
    part, filter_order, step, kept, removed, redundant (failing, removed earlier), unique_fails (failing this filter only),
    good_lost and toxic_lost (removed here, labelled quality 1 or toxic 1), shapley (removed by the filter, summed over all
    120 orders). All are 0 where nothing is to be counted.

    A null text is an empty one, a null part the empty string. A row without a key never fails E, makes no other fail it and
    has no label. Rows of equal key and text are all first or all not. A key with several labels is good if any says so, and
    toxic likewise. An empty table gives no rows. Texts of any length are compared whole. Extra columns are not looked at.

    The sketch has 16 cells a row and ``most_cells`` at most, an eighth of that in bytes for each worker (32 MB by default);
    beyond 16 million rows it grows no further and clears fewer unique texts, which then are shuffled too: slower, with
    equal results.
    """
    own = masks(docs, key=key, text=text, part=part, most_cells=most_cells)
    says = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(f"__{name}")
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(says("quality"), says("toxic"))
    counted = own.join(known, F.col("__id") == F.col("__key"), "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("__quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("__toxic"), F.lit(0)).alias("toxic"))
    # at most 32 rows a part
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")))
    at = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    parts = counted.groupBy("part").agg(at.alias("__at"))
    parts = parts.select("part", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.element_at("__at", m), none)).alias("__counts"))
    steps = parts.select("part", "__counts", F.explode(F.lit(ORDERS)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda c: F.element_at(F.create_map(*(F.lit(x) for pair in BITS.items() for x in pair)), c)
    letters = F.split(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1), "")
    before = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda a, c: a + bit(c))
    letter = bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    steps = steps.withColumns({"__before": before, "__letter": letter})
    return steps.select("part", "filter_order", "step", *(c.alias(name) for name, c in _step(F.col("__counts"), F.col("__before"), F.col("__letter")).items()))
