"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise

SPREAD = 16  # tasks that the edges of one node are dealt to


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of an edge; the component's name is its least node.

    ``edges`` has the columns u and v of any type that has an order. Each round a node goes over to its least neighbour,
    and to where that one goes, and the edges are rewritten between the nodes that are left; equal ones and loops go, so
    the graph shrinks by what a round has tied together. The moves of all rounds in turn give each node's component.
    Least neighbours are combined before the shuffle. Each round is written to the shared folder. Loops, repeated edges
    and rows with a null are ignored.
    """
    def between(u, v, rows: DataFrame) -> DataFrame:
        return rows.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u <> v").distinct()

    pairs = materialise(between(F.col("u"), F.col("v"), edges.filter("u is not null and v is not null")), "edges")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    labels = materialise(nodes.withColumn("component", F.col("node")), "labels")
    while not pairs.isEmpty():
        nearest = pairs.groupBy("v").agg(F.min("u").alias("up"))
        further = nearest.select(F.col("v").alias("at"), F.col("up").alias("further"))
        moves = nearest.join(further, nearest.up == further.at, "left")
        moves = materialise(moves.select(F.col("v").alias("from"), F.coalesce("further", "up").alias("to")), "moves")
        # many edges may begin at one node, so they and copies of its move are dealt out by the other end
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SPREAD)))
        spread = moves.toDF("u", "u_to").withColumn("part", F.explode(F.lit(list(range(SPREAD))).cast("array<bigint>")))
        moved = dealt.join(spread, ["u", "part"], "left").join(moves.toDF("v", "v_to"), "v")
        left = materialise(between(F.coalesce("u_to", "u"), F.col("v_to"), moved), "edges")
        renamed = labels.join(moves.toDF("component", "to"), "component", "left")
        renamed = materialise(renamed.select("node", F.coalesce("to", "component").alias("component")), "labels")
        for done in (pairs, moves, labels):
            discard(done)
        pairs, labels = left, renamed
    return labels
