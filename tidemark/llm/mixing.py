"""Interleaving sources so that at every moment each is less than one block off its target weight (Pfair windows)."""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_DOCS = 16
MOST_SHARES = 100_000
TEMPERED_SHARES = 1000
BUCKET_ROWS = 256
BUCKETS_TOGETHER = 1024

Source = str | None


def tempered_shares(counts: Mapping[Source, int], exponent: float = 0.5, total: int = TEMPERED_SHARES) -> dict[Source, int]:
    """Whole shares in proportion to a power of each source's count, by largest remainders; each has one at least."""
    total = max(total, 4 * len(counts))
    powers = {s: max(n, 1) ** exponent for s, n in counts.items()}
    free, scale = total - len(counts), sum(powers.values()) or 1.0
    exact = {s: free * p / scale for s, p in powers.items()}
    shares = {s: 1 + int(x) for s, x in exact.items()}
    ranked = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))
    for s in ranked[:total - sum(shares.values())]:
        shares[s] += 1
    return shares


def pfair_slots(shares: Mapping[Source, int]) -> dict[Source, list[int]]:
    """The slots of each source in one round of ``sum(shares)`` slots.

    Block j of a source of weight w may not begin before its release floor(j / w) and must be done by its deadline
    ceil((j + 1) / w). In each slot the released block of the earliest deadline runs. The weights are parts of the round
    and add up to one, so the windows can all be met and each round is like the first.
    """
    period = sum(shares.values())
    waiting = [(0, -(-period // n), s is None, s or "", s) for s, n in shares.items()]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slots: dict[Source, list[int]] = {s: [] for s in shares}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, deadline, *name = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, *name))
        deadline, *_, source = heapq.heappop(ready)
        slots[source].append(slot)
        j, weight = len(slots[source]), Fraction(shares[source], period)
        heapq.heappush(waiting, (int(j / weight), -int(-(j + 1) // weight), source is None, source or "", source))
    return slots


def _name(source: str) -> Column:
    """A source's name as a key that tells null from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def ranked(docs: DataFrame, source: str, key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``__source`` and ``__rank``, the place from 0 of each row in an order of its source that hashes the key.

    A source's rows are dealt into buckets of about ``bucket_rows`` by the hash, so no task gets a whole source. Counts
    of buckets and of groups of buckets are added up to the number of rows before each bucket.
    """
    order = F.xxhash64(key)
    counts = docs.groupBy(_name(source).alias("__source")).agg(F.ceil(F.count("*") / bucket_rows).alias("__n"))
    # as few rows as there are sources
    placed = docs.withColumns({"__source": _name(source), "__order": order}).join(F.broadcast(counts), "__source")
    placed = placed.withColumn("__bucket", F.pmod("__order", "__n"))
    slim = docs.select(_name(source).alias("__source"), order.alias("__order")).join(F.broadcast(counts), "__source")
    buckets = slim.groupBy("__source", F.pmod("__order", "__n").alias("__bucket")).agg(F.count("*").alias("rows"))
    buckets = buckets.withColumn("group", F.floor(F.col("__bucket") / BUCKETS_TOGETHER))
    groups = buckets.groupBy("__source", "group").agg(F.sum("rows").alias("rows"))
    before = lambda by, at: F.coalesce(F.sum("rows").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("__source", "group", before(["__source"], "group").alias("earlier"))
    buckets = buckets.withColumn("within", before(["__source", "group"], "__bucket")).join(groups, ["__source", "group"])
    buckets = buckets.select("__source", "__bucket", (F.col("earlier") + F.col("within")).alias("__before"))
    own = W.partitionBy("__source", "__bucket").orderBy("__order", F.col(key).asc_nulls_first())
    placed = placed.withColumn("__nth", F.row_number().over(own)).join(buckets, ["__source", "__bucket"])
    return placed.withColumn("__rank", F.col("__before") + F.col("__nth") - 1).drop("__n", "__bucket", "__nth", "__before", "__order")


def mixed(
    docs: DataFrame, shares: Mapping[Source, int] | None = None, *, key: str = "doc_id", source: str = "source",
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``docs`` with ``__block``, ``__release``, ``__deadline``, ``__slot`` and ``__place``: ordered by slot and place, they are mixed.

    A source's documents, in an order that hashes the key, are cut into blocks of ``block_docs``. ``shares`` are whole
    numbers; a source's target weight is its part of their sum. If not given they go with the root of the number of
    documents. One round of slots is planned for the shares, and as all rounds are alike block j of a source finds its
    slot by division; release and deadline are the window that the target weight gives the block. Until the first source
    ends, each source's blocks in any number of slots are less than one off its weight. Slots of sources that have ended
    stay empty, so the others go on in proportion. Every row is kept, once. A null source is a source of its own, as is
    an empty one. Rows without a key come first in their source; repeated rows are rows like others. Sources that
    ``shares`` doesn't name are an error, as are more than 100,000 shares in all. An empty table gives no rows.
    """
    if shares is None:
        rows = docs.groupBy(F.col(source).cast("string").alias("s")).count().limit(MOST_SHARES // 4 + 1).collect()
        shares = tempered_shares({r["s"]: r["count"] for r in rows})
    else:
        rows = docs.groupBy(F.col(source).cast("string").alias("s")).count().limit(MOST_SHARES + 1).collect()
    missing = {r["s"] for r in rows} - set(shares)
    if missing or sum(shares.values()) > MOST_SHARES or any(n < 1 for n in shares.values()):
        raise ValueError(f"shares must be whole numbers from 1, {MOST_SHARES} in all at most, for each source; without one: {sorted(map(str, missing))[:9]}")
    spark = docs.sparkSession
    table = spark.createDataFrame(_plan(shares), "__source string, __share long, __turn long, __first long")
    period = sum(shares.values())
    blocks = ranked(docs, source, key).withColumns({"__block": F.floor(F.col("__rank") / block_docs), "__place": F.col("__rank") % block_docs})
    share = F.broadcast(table.groupBy("__source").agg(F.first("__share").alias("__share")))
    blocks = blocks.join(share, "__source").withColumn("__turn", F.col("__block") % F.col("__share"))
    # a row for each slot of one round, so bounded by MOST_SHARES
    out = blocks.join(F.broadcast(table.drop("__share")), ["__source", "__turn"])
    # whole rounds are added apart, so that no product grows with the number of blocks
    rounds, turn = F.floor(F.col("__block") / F.col("__share")), F.col("__turn")
    return out.select(
        *(F.col(c) for c in docs.columns), "__block",
        (rounds * period + F.floor(turn * period / F.col("__share"))).alias("__release"),
        (rounds * period + F.ceil((turn + 1) * period / F.col("__share"))).alias("__deadline"),
        (rounds * period + F.col("__first")).alias("__slot"), "__place",
    )


def _plan(shares: Mapping[Source, int]) -> list[tuple[str, int, int, int]]:
    return [("null" if s is None else f"={s}", shares[s], turn, slot) for s, slots in pfair_slots(shares).items() for turn, slot in enumerate(slots)]


def schedule(docs: DataFrame, shares: Mapping[Source, int] | None = None, *, key: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """key, source, block, release, deadline, slot and place of each row; see :func:`mixed`."""
    found = mixed(docs.select(key, source), shares, key=key, source=source, block_docs=block_docs)
    names = ("block", "release", "deadline", "slot", "place")
    return found.select(key, source, *(F.col(f"__{n}").alias(n) for n in names))


def in_mixed_order(docs: DataFrame, shares: Mapping[Source, int] | None = None, *, key: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs``, all rows and columns, ordered as they are mixed: by partition, and within each."""
    found = mixed(docs, shares, key=key, source=source, block_docs=block_docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = mixed(docs.select(key, source), shares, key=key, source=source, block_docs=block_docs)
    edges = slots.agg(F.percentile_approx("__slot", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    edges = sorted(set(edges or []))
    part = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda a, e: a + (F.col("__slot") > e).cast("int")) if edges else F.lit(0)
    return found.repartitionById(len(edges) + 1, part).sortWithinPartitions("__slot", "__place").select(*docs.columns)
