"""Periodic runs in texts: stretches of words that go round with a fixed period, four times or more.

Dyadic square catching. A level with blocks of ``b`` words (a power of two) is there for the periods from ``b`` to
``2 b - 1``. The block that begins at a multiple ``a`` of ``b`` gets a catcher as soon as it and the block after it are
complete; the catcher compares these ``2 b`` words with the suffix of the text after each appended word, as long as the
suffix begins between ``a + b`` and ``a + 2 b - 1``. So after each word a level makes one comparison: with the only
catcher for which the suffix begins there. As more words than a period agree, what is caught ends a square. Suffixes are
compared by hash, those of a level from those of the level below; all comparisons that the words of a text advance on
one level are one array operation. Squares that no known run holds are extended word by word to both sides, and the
squares of one period that overlap merge into one run.

A run with four periods holds ``3 p >= 3 b`` words that equal those a period on, and so a whole catcher of its level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship
from .words import bound, stripped, words_of

EXPONENT = 4
LEAST_WORDS = 6
BYTES_AT_ONCE = 1 << 21


def _agreeing(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, to the right (step 1) or left (-1), equal the word ``period`` before."""
    total, size = 0, 32
    while True:
        if step > 0:
            first, last = at + total, min(len(ids), at + total + size)
        else:
            first, last = max(period, at - total - size + 1), at - total + 1
        if last <= first:
            return total
        same = ids[first:last] == ids[first - period:last - period]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return total + int(same.argmin())
        total, size = total + last - first, size * 2


def _caught(h: np.ndarray, b: int) -> np.ndarray:
    """Where suffixes of ``2 b`` words begin that a catcher of the level equals; ``h`` has the hash from each place."""
    rows = len(h) // b
    if rows < 1:
        return np.zeros(0, np.int64)
    grid = h[:rows * b].reshape(rows, b)
    found = np.flatnonzero(grid[1:] == grid[:-1, :1]) + b
    rest = np.flatnonzero(h[rows * b:] == grid[-1, 0]) + rows * b
    return np.concatenate([found, rest])


def runs_of(ids: np.ndarray, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text whose words are numbered by ``ids``, by start and period.

    A run is a maximal stretch with smallest period q that is at least ``least`` and ``exponent * q`` words long, with an
    exponent of 4 or more and a least length of 6 at most. The work is n log n however the words repeat: what lies in a
    run that is known is never extended again.
    """
    n, b = len(ids), 1
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    known: list[tuple[int, int, int]] = []  # start, end, period
    while 4 * b <= n:
        h = h[:-b] * np.uint64(0xD1B54A32D192ED03) + h[b:]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        at = _caught(h, b)
        if len(at):
            block = (at // b - 1) * b
            period, open_ = at - block, np.ones(len(at), bool)
            for start, end, q in known:
                if end - start >= 4 * b:
                    i, j = np.searchsorted(at, (start, end))
                    open_[i:j] &= (block[i:j] < start) | (at[i:j] + 2 * b > end) | (period[i:j] % q != 0)
            ends: dict[int, int] = {}  # of the last run of a period, as places grow
            for i, p in zip(at[open_].tolist(), period[open_].tolist()):
                if i + 2 * b <= ends.get(p, 0):
                    continue
                right = _agreeing(ids, i, p, 1)
                if right < 2 * b:
                    continue  # equal hashes of other words
                start, end = i - p - _agreeing(ids, i - 1, p, -1), i + right
                ends[p] = end
                if end - start >= max(least, exponent * p):
                    known.append((start, end, p))
        b *= 2
    least_period: dict[tuple[int, int], int] = {}
    for start, end, p in known:
        least_period[start, end] = min(p, least_period.get((start, end), p))
    return sorted((start, end - start, p) for (start, end), p in least_period.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words of the text."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words any run contains after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _slices(batch: pa.RecordBatch, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of text, one row at least."""
    total, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def periodic_runs(
    docs: DataFrame, *, key: str = "doc_id", text: str | Column = "text", exponent: int = EXPONENT, least: int = LEAST_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: the key, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are parted by ASCII white space, case counts. Start is the number of a run's first word, from 0. ``collapsed``
    is the text without the words that lie in a run after its first period, the others joined by one blank. ``exponent``
    is 4 at least, ``least`` 6 at most.

    A null, empty or blank text has no runs and an empty collapsed text. A text is worked on whole, in n log n steps and
    with memory in proportion to it, whatever its length. Rows stand for themselves: null, tied and repeated keys and
    repeated rows are all kept. An empty table gives no rows. Other columns are not looked at, whatever their names. No
    shuffle.
    """
    if exponent < EXPONENT or least > LEAST_WORDS:
        raise ValueError(f"runs are found from exponent {EXPONENT} on, and a least length of {LEAST_WORDS} at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for batch in _slices(whole):
                found, left = [], []
                for t in batch.column("__text").to_pylist():
                    words = (t or b"").split()
                    runs = runs_of(numbered(words), exponent, least)
                    found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    left.append(b" ".join(compress(words, (~dropped(len(words), runs)).tolist()) if runs else words))
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(found, kind), pa.array(left, pa.binary())], [key, "runs", "collapsed"])

    ship(docs.sparkSession)
    own = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.col(key).alias("__id"), own.cast("string").cast("binary").alias("__text"))
    schema = f"`{key}` {dict(docs.dtypes)[key]}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    return source.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def echoed(key: Column, text: Column) -> Column:
    """The text of which a tenth of the documents, by the hash of the key, goes round from some word on.

    With h the crc32 of the key in decimal, g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), each
    word from a on becomes word a + (i - a) % p if h % 10 = 0. Up to ten rounds of p words reach the end.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def turned(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n.cast("long")).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), 10)), F.lit(1), n - a)
        return F.concat_ws(" ", F.slice(w, F.lit(1), a), again)

    chosen = (F.pmod(h, F.lit(10)) == 0) & (stripped(text) != "")
    return F.when(chosen, bound(words_of(text), turned)).otherwise(text)


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``, on echoed texts: n_runs, the longest run, and hashes of all runs and of the collapsed text."""
    own = periodic_runs(docs, key=key, text=echoed(F.col(key), F.col(text)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    size, period = F.col("__longest.length"), -F.col("__longest.p")
    return own.withColumn("__longest", longest).select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("__longest.s")).alias("start"), size.alias("length"), period.alias("period"),
        F.floor(1000 * size / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
