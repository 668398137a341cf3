"""MinHash banding over word n-grams: signatures, candidate clusters and their exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise
from . import graph
from .memory import tidy

WORDS = 5
SIMILARITY = 0.8
ROWS = 4
CHUNK = 128  # members of a cluster that meet as many others in one unit of work


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """How many bands of ``rows`` find a pair of the given similarity with at least the probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: lower case, parted by ASCII white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """64-bit hashes of the distinct word n-grams, in order; of all words together, if there are fewer than n."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    size = min(n, len(words))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ h[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit hash for each band of the MinHash signature."""
    a, b = _multipliers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 256):  # as much as stays near the processor
        least = np.minimum(least, (grams[at:at + 256, None] * a + b).min(axis=0))
    sign = (least >> np.uint64(24)).reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for k in range(rows):
        out = (out ^ sign[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def content_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def candidate_clusters(signed: DataFrame) -> DataFrame:
    """``node, cluster`` of the nodes that share a band with another. ``signed`` has a row per node: node, bands.

    A bucket's nodes are tied to its least node, not to each other: first within a batch of rows, then the least nodes of
    all batches, so a bucket sends as many rows through the shuffle as batches know it, however many nodes it has.
    """
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("bucket", pa.int64()), ("u", pa.binary()), ("v", pa.binary())])
        for batch in batches:
            nodes = batch.column("node")
            bands = batch.column("bands")
            rank = np.argsort(pc.sort_indices(nodes).to_numpy())
            size = pc.list_value_length(bands).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), size)
            bucket = bands.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((rank[owner], bucket))
            bucket, owner = bucket[order], owner[order]
            first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else np.zeros(0, np.int64)
            least = owner[np.repeat(first, np.diff(np.append(first, len(bucket))))] if len(bucket) else owner
            tied = np.unique(np.stack([owner, least])[:, owner != least], axis=1)
            take = lambda at: nodes.take(pa.array(at, pa.int64()))
            own, n = owner[first], tied.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), take(own), pa.nulls(len(own), pa.binary())], schema=kind)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), take(tied[0]), take(tied[1])], schema=kind)

    met = materialise(signed.select("node", "bands").mapInArrow(run, "bucket long, u binary, v binary"), "buckets")
    rows = met.filter("bucket is not null").select("bucket", "u")
    shared = rows.groupBy("bucket").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").select("bucket", "v")
    edges = rows.join(shared, "bucket").select("u", "v").unionByName(met.filter("bucket is null").select("u", "v"))
    out = graph.components(edges)
    discard(met)
    return out


def with_units(clusters: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``node, cluster, side, units``: which units of work a node takes part in.

    A cluster of up to ``chunk`` nodes is whole in one unit, together with other small ones. A larger one is dealt
    into chunks by a hash of the node, and each pair of chunks is a unit of its own; side is the node's chunk.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    few = sizes.filter(F.col("n") <= chunk).agg(F.sum("n")).first()[0] or 0
    bins = max(1, few // chunk)
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    side = F.pmod(F.xxhash64("node"), chunks).cast("int")
    alone = F.array(F.struct(F.lit(None).cast("binary").alias("of"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j")))
    many = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(
        F.col("cluster").alias("of"), F.least(k, F.col("side")).alias("i"), F.greatest(k, F.col("side")).alias("j")))
    sized = clusters.join(sizes, "cluster").withColumns({"chunks": chunks, "side": side})
    return sized.select("node", "cluster", "side", F.when(F.col("chunks") > 1, many).otherwise(alone).alias("units"))


def similar_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Square matrix: which sets have a Jaccard similarity of at least ``similarity``."""
    size = np.array([len(s) for s in sets], np.float64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = counts > 1
    column = np.cumsum(shared) - 1
    kept = shared[inverse]
    owner, column = owner[kept], column[inverse[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    step = 4096
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (at, at + step))
        held = np.zeros((len(sets), step), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        common += held @ held.T
    union = size[:, None] + size - common
    return common / np.maximum(union, 1) >= similarity


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that tie together what the pairs tie together; fewer than n."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def verified(units: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Exact links within units: ``u, v, n``.

    ``units`` has node, cluster, side, unit (of, i, j) and grams, the node's set as bytes. Rows with v are edges that
    tie the linked nodes together, as few as that takes; rows without are the number of links n that u has in the unit.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.sort_values(["cluster", "node"]).drop_duplicates(["cluster", "node"]).groupby("cluster", sort=False):
            nodes, side = own["node"].tolist(), own["side"].to_numpy()
            linked = similar_pairs([np.frombuffer(g, "<u8") for g in own["grams"]], similarity)
            np.fill_diagonal(linked, False)
            if own["i"].iloc[0] != own["j"].iloc[0] and own["of"].iloc[0] is not None:
                linked &= side[:, None] != side
            out += [(nodes[k], None, int(n)) for k, n in enumerate(linked.sum(axis=1)) if n]
            out += [(nodes[a], nodes[b], None) for a, b in _forest(np.argwhere(np.triu(linked)), len(nodes))]
        return pd.DataFrame(out, columns=["u", "v", "n"])

    flat = units.select("unit.of", "unit.i", "unit.j", "node", "cluster", "side", "grams")
    return flat.groupBy("of", "i", "j").applyInPandas(run, "u binary, v binary, n long")


def links(signed: DataFrame, texts, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The classes of linked nodes (``node, component``) and each linked node's number of links (``node, n_links``).

    ``signed`` has node and bands. ``texts`` is a function from the candidates (with a column node) to the
    candidates with a column grams.
    """
    clusters = candidate_clusters(signed).withColumnRenamed("component", "cluster")
    members = materialise(with_units(clusters), "members")
    work = texts(members).withColumn("unit", F.explode("units"))
    found = materialise(verified(work, similarity), "links")
    classes = graph.components(found.filter("v is not null"))
    discard(members)
    counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    return classes, counts


def grams_of(df: DataFrame, carried: list[str], text: str = "__text", key: str = "node", n: int = WORDS) -> DataFrame:
    """``carried`` columns and grams, for the rows whose text has the content key ``key``."""
    kinds = dict(df.dtypes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(text).to_pylist()]
            keep = [i for i, (w, k) in enumerate(zip(words, batch.column(key).to_pylist())) if content_key(w) == k]
            grams = pa.array([shingles(words[i], n).astype("<u8").tobytes() for i in keep], pa.binary())
            rows = batch.select(carried).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, grams], [*carried, "grams"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "grams binary"])
    return df.select(*dict.fromkeys([*carried, key, text])).mapInArrow(run, schema)
