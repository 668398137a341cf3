"""Exact largest inner products by best-first search of M-trees.

With one more coordinate, sqrt(m - |x|^2) for a row x and 0 for a query q, where m is the greatest square length of a
row, the square distance of q and x is |q|^2 + m - 2 q.x: the nearest rows are those of the largest products, and the
distance is a metric. A tree holds rows that are near one pivot; pages of entries, each page with a routing row, the
covering radius of its entries and the distance of every entry from the routing row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise, ship

PIVOTS = 16
TREE_ROWS = 2048
PAGE_ROWS = 64
QUERIES_TOGETHER = 256
SEEDS = 8192
SLACK = 1e-6


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id, vec``: floor(scale * x) of each component as 32-bit integers, of rows with a key and finite components only."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = rows.filter(F.coalesce(good, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(scale))).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("whole")
            flat, edge = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            edge = edge - edge[0]
            if len(flat) and max(abs(int(flat.min())), abs(int(flat.max()))) >= 1 << 24:
                raise ValueError("components must be less than 2**24 after scaling, so that products are exact")
            raw = flat.astype("<i4")
            packed = [raw[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "vec"])

    return whole.mapInArrow(run, "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), -1).astype(np.float64)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that gives all the same length."""
    return np.concatenate([x, np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)))


def build_tree(vectors: list[bytes], longest: float) -> dict[str, np.ndarray]:
    """Pages of a tree over the given rows: routing rows, radii, page edges, the order of rows, and distances from the routing row."""
    x = _matrix(vectors)
    lifted = _lifted(x, longest)
    n_pages = max(1, math.ceil(len(x) / PAGE_ROWS))
    chosen = [0]
    apart = _distances(lifted, lifted[:1])[:, 0]
    for _ in range(n_pages - 1):  # routing rows far from each other
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _distances(lifted, lifted[chosen[-1]:chosen[-1] + 1])[:, 0])
    near = _distances(lifted, lifted[chosen])
    page, own = near.argmin(axis=1), near.min(axis=1)
    order = np.lexsort((own, page))
    page, own = page[order], own[order]
    # a page has no more than PAGE_ROWS entries: the rest go to further pages with the same routing row
    first = np.searchsorted(page, page)
    cut = np.flatnonzero(((np.arange(len(page)) - first) % PAGE_ROWS == 0))
    edge = np.append(cut, len(page))
    radius = np.array([own[a:b].max() for a, b in zip(edge[:-1], edge[1:])])
    return {"routing": order_rows(x, np.array(chosen)[page[cut]]), "radius": radius, "edge": edge, "order": order, "parent": own}


def order_rows(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    return x[order]


def search_tree(tree: dict[str, np.ndarray], rows: np.ndarray, ids: list[list[int]], queries: np.ndarray, own: list[int], floors: np.ndarray, longest: float, k: int) -> Iterator[tuple[int, int, int]]:
    """(query number, id, score) of each query's k largest products in the tree that are at least its floor.

    Pages are taken nearest first, by the distance of the routing row less the radius, until no page can hold a row
    near enough; in a page only those rows are computed whose stored distance from the routing row leaves them a chance.
    ``rows`` are in page order, each with the ids that have it.
    """
    square = (queries * queries).sum(axis=1)
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    to_page = _distances(lifted, _lifted(tree["routing"], longest))
    least = np.maximum(0, to_page - tree["radius"])
    edge, parent, floors = tree["edge"], tree["parent"], floors.copy()
    nearest = np.argsort(least, axis=1, kind="stable")
    every, active = np.arange(len(queries)), np.ones(len(queries), bool)
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    for turn in range(nearest.shape[1]):  # each query's next page; queries of one page together
        page = nearest[:, turn]
        reach = np.full(len(queries), math.inf)
        known = floors > -math.inf
        reach[known] = np.sqrt(np.maximum(0, square[known] + longest - 2 * floors[known])) * (1 + SLACK) + SLACK
        active &= least[every, page] <= reach  # all that a query has left is farther away
        changed = set()
        for p in np.unique(page[active]):
            own_turn = np.flatnonzero(active & (page == p))
            a, b = edge[p], edge[p + 1]
            chance = np.abs(parent[a:b, None] - to_page[own_turn, p]) <= reach[own_turn]
            near = a + np.flatnonzero(chance.any(axis=1))
            scores = rows[near] @ queries[own_turn].T
            for i, j in zip(*np.nonzero(scores >= floors[own_turn])):
                q = own_turn[j]
                found = [(-int(scores[i, j]), x) for x in ids[near[i]] if x != own[q]]
                best[q] += found
                if found:
                    changed.add(q)
        for q in changed:
            best[q] = sorted(best[q])[:k]
            if len(best[q]) == k:
                floors[q] = max(floors[q], -best[q][-1][0])
    for q, found in enumerate(best):
        for score, x in found:
            yield q, x, -score


def largest_products(
    vectors: DataFrame, is_query, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
    pivots: int = PIVOTS, tree_rows: int = TREE_ROWS, queries_together: int = QUERIES_TOGETHER, seeds: int = SEEDS,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k other rows of the largest integer product with each query.

    Components are floor(scale * x). Ties go to the smaller key. A query with fewer than k other rows gets them all.
    Rows with a null key or vector, or a null or non-finite component, take no part; an empty vector has no component
    and takes part. Products are of vectors of one length; others never meet. Repeated rows count once; a key with
    several vectors has the least. An empty table gives no rows.

    Equal vectors are one entry, which holds the k + 1 least of its keys: no other can be among the k. Keys are ranked
    within salted parts first, so no vector's copies meet in one task. Each entry goes to the nearest of a bounded sample
    of ``pivots``, and a pivot's entries are dealt into trees of about ``tree_rows``. Blocks of about ``queries_together``
    queries meet each tree. A query starts with the k-th product among ``seeds`` sampled entries as its floor.
    """
    spark = vectors.sparkSession
    ship(spark)
    all_rows = materialise(whole_vectors(vectors, key, vector, scale), "vectors")
    n = all_rows.count()
    # so many parts that neither a part of one vector's keys nor what is left of all its parts grows faster than the root of n
    salts = max(1, math.isqrt(n // (k + 1)))
    few = W.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
    fewer = W.partitionBy("vec").orderBy("id")
    ranked = all_rows.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1)
    ranked = ranked.withColumn("r", F.row_number().over(fewer)).filter(F.col("r") <= k + 1)
    entries = materialise(ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")  # k + 1 ids at most
    sample = entries.orderBy(F.xxhash64("vec"), "vec").limit(max(seeds, pivots)).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sample:
        return empty
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["vec"]), []).append((bytes(r["vec"]), r["ids"]))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = [int((np.frombuffer(v, "<i4").astype(np.int64) ** 2).sum()) for batch in batches for v in batch.column("vec").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([max(most, default=0)], pa.int64())], ["s"])

    longest = float(entries.select("vec").mapInArrow(squares, "s long").agg(F.max("s")).first()[0])
    held = {size: _lifted(_matrix([v for v, _ in own[:pivots]]), longest) for size, own in by_size.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            cell = np.zeros(len(vecs), np.int32)
            sizes = np.array([len(v) for v in vecs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size in held:  # sizes that the sample lacks have one cell
                    cell[at] = _distances(_lifted(_matrix([vecs[i] for i in at]), longest), held[size]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec", "ids", "cell"])

    placed = entries.select("vec", "ids").mapInArrow(nearest, "vec binary, ids array<bigint>, cell int")
    placed = materialise(placed.withColumn("size", F.octet_length("vec")), "placed")
    cells = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / tree_rows).cast("int").alias("trees"))
    placed = placed.join(F.broadcast(cells), ["size", "cell"])  # a row for each pivot and length
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec"), F.col("trees")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec")
        vecs, ids = table["vec"].to_pylist(), table["ids"].to_pylist()
        tree = build_tree(vecs, longest)
        order = tree["order"]
        flat = [ids[i] for i in order]
        row = {
            "size": table["size"][0].as_py(), "cell": table["cell"][0].as_py(), "part": table["part"][0].as_py(),
            "routing": tree["routing"].astype("<i4").tobytes(), "radius": tree["radius"].tolist(), "edge": tree["edge"].tolist(),
            "vectors": b"".join(vecs[i] for i in order), "parent": tree["parent"].tolist(), "ids": flat,
        }
        return pa.Table.from_pylist([row], schema=tree_schema)

    tree_schema = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("routing", pa.binary()), ("radius", pa.list_(pa.float64())),
                             ("edge", pa.list_(pa.int64())), ("vectors", pa.binary()), ("parent", pa.list_(pa.float64())), ("ids", pa.list_(pa.list_(pa.int64())))])
    shape = "size int, cell int, part int, routing binary, radius array<double>, edge array<bigint>, vectors binary, parent array<double>, ids array<array<bigint>>"
    trees = materialise(placed.groupBy("size", "cell", "part").applyInArrow(build, shape), "trees")

    seeds_of = {
        size: (_matrix([v for v, found in own for _ in found]), np.array([x for _, found in own for x in found], np.int64)) for size, own in by_size.items()}

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th product of each query with the seeds, none if there are fewer."""
        for batch in batches:
            ids, vecs = batch.column("id").to_numpy(), batch.column("vec").to_pylist()
            out = np.full(len(ids), -np.inf)
            sizes = np.array([len(v) for v in vecs])
            for size, (rows, names) in seeds_of.items():
                for at in np.array_split(np.flatnonzero(sizes == size), max(1, len(ids) // 256)):
                    if len(at) and len(names) >= k:
                        scores = _matrix([vecs[i] for i in at]) @ rows.T
                        scores[names == ids[at, None]] = -np.inf
                        out[at] = np.partition(scores, len(names) - k, axis=1)[:, -k]
            column = pa.array(out, pa.float64(), mask=np.isinf(out))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], ["id", "vec", "floor"])

    queries = all_rows.filter(is_query(F.col("id"))).mapInArrow(floors, "id long, vec binary, floor double")
    queries = materialise(queries, "queries").withColumn("size", F.octet_length("vec"))
    blocks = max(1, -(-queries.count() // queries_together))
    blocks_of = queries.groupBy("size", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "vec", "floor")).alias("queries"))
    names = trees.select("size", "cell", "part")
    # a stated set of queries against all rows, block by tree
    meets = blocks_of.select("size", "block").join(names, "size").join(blocks_of, ["size", "block"]).join(trees, ["size", "cell", "part"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def search(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        for row in table.to_pylist():
            own = [q["id"] for q in row["queries"]]
            wanted = _matrix([q["vec"] for q in row["queries"]])
            n_rows = len(row["ids"])
            tree = {
                "routing": np.frombuffer(row["routing"], "<i4").reshape(len(row["radius"]), -1).astype(np.float64), "radius": np.array(row["radius"]),
                "edge": np.array(row["edge"], np.int64), "parent": np.array(row["parent"]),
            }
            held_rows = np.frombuffer(row["vectors"], "<i4").reshape(n_rows, -1).astype(np.float64)
            floor = np.array([-math.inf if q["floor"] is None else q["floor"] for q in row["queries"]])
            out += [(own[q], x, s) for q, x, s in search_tree(tree, held_rows, row["ids"], wanted, own, floor, longest, k)]
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        return pa.Table.from_arrays(columns, ["query_id", "vec_id", "score"])

    found = meets.repartition(parts, "size", "cell", "part", "block").groupBy("size", "cell", "part", "block").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
