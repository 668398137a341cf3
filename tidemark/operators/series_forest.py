"""A regression forest for each series, all grown together.

Trees are grown level by level. Key, tree and node are columns, so one aggregate of a level fills the histograms of every
open node of every tree of every series, and a second picks the splits. The number of jobs grows with the depth, not with
the series or the trees. Features are cut into bins at quantiles of their series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, materialise

# The distribution of a Poisson variable of mean 1, up to 0, 1, 2, ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
ACCURACY = 10_000


@dataclass(frozen=True)
class SeriesForest:
    """Settings. A bootstrap draws each row a Poisson number of times for each tree; a split is looked for in a share of the features."""

    trees: int = 20
    depth: int = 5
    bins: int = 32
    least_rows: int = 2
    bootstrap: bool = True
    feature_share: float = 1.0


def _share(*columns: Column | str) -> Column:
    """A number from 0 to 1 that hashes the columns: equal for equal rows wherever and whenever they are worked on."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / float(1 << 31)


def fit(
    df: DataFrame, key: Sequence[str], features: Sequence[str], target: str, settings: SeriesForest = SeriesForest(), date: str = "date",
) -> DataFrame:
    """The nodes of all trees: ``key, tree, node, feature, threshold, value, n``; it is stored in the shared folder.

    Node 1 is a tree's root, 2 k and 2 k + 1 are the children of k. An inner node sends rows whose feature (a number among
    ``features``) is at most the threshold, or null, to the first child; a leaf has a value, the mean of its ``n`` rows.
    A split needs ``least_rows`` rows on both sides and a smaller squared error; of equal ones the first feature and bin
    count. Rows without a target are left out; a series without rows has no tree. ``date`` tells a series' rows apart
    for the bootstrap.
    """
    s = settings
    cuts = [k / s.bins for k in range(1, s.bins)]
    names = [f"_f{i}" for i in range(len(features))]
    rows = df.filter(F.col(target).isNotNull()).select(*key, F.col(date).alias("_date"), F.col(target).cast("double").alias("y"),
                                                       *(F.col(f).cast("double").alias(n) for f, n in zip(features, names)))
    edges = rows.groupBy(*key).agg(F.array(*(F.array_distinct(F.coalesce(F.percentile_approx(n, cuts, ACCURACY), F.array().cast("array<double>"))) for n in names)).alias("edges"))
    edges = materialise(edges, "edges")
    above = lambda i: F.size(F.filter(F.col("edges")[i], lambda e: F.col(names[i]) > e))
    binned = rows.join(edges, list(key)).select(*key, "_date", "y", F.array(*(above(i) for i in range(len(names)))).alias("x"))
    drawn = binned.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(s.trees - 1))))
    u = _share(*key, "_date", "tree")
    times = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0)) if s.bootstrap else F.lit(1)
    drawn = drawn.withColumn("w", times.cast("double")).filter("w > 0").drop("_date")
    grown = materialise(drawn.withColumns({"node": F.lit(1), "open": F.lit(True)}), "grown")
    place, levels = [*key, "tree", "node"], []
    for _ in range(s.depth):
        cells = grown.filter("open").select(*place, "w", "y", F.posexplode("x").alias("feature", "bin"))
        if s.feature_share < 1:
            cells = cells.filter((_share("tree", "node", "feature", F.lit(7)) < s.feature_share))
        histogram = cells.groupBy(*place, "feature", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("sum"))
        whole = W.partitionBy(*place, "feature")
        upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        sided = histogram.select(*place, "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("sum").over(upto).alias("sl"),
                                 F.sum("n").over(whole).alias("nn"), F.sum("sum").over(whole).alias("ss"))
        nr, sr = F.col("nn") - F.col("nl"), F.col("ss") - F.col("sl")
        sided = sided.filter((F.col("nl") >= s.least_rows) & (nr >= s.least_rows))
        # the gain as a product of the distance of the means: 0 where they are equal, without cancellation
        gain = F.col("nl") * nr / F.col("nn") * F.pow(F.col("sl") / F.col("nl") - sr / nr, F.lit(2))
        best = sided.withColumn("gain", gain).groupBy(*place).agg(
            F.max("gain").alias("gain"), F.max_by(F.struct("feature", "bin"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("split"))
        splits = materialise(best.filter("gain > 1e-12").select(*place, "split.feature", "split.bin"), "splits")
        if splits.isEmpty():
            break
        levels.append(splits)
        told = grown.join(splits, place, "left")
        child = 2 * F.col("node") + F.when(F.get("x", F.col("feature")) > F.col("bin"), 1).otherwise(0)
        moved = materialise(told.select(*key, "tree", "y", "x", "w", F.when(F.col("feature").isNotNull(), child).otherwise(F.col("node")).alias("node"),
                                        F.col("feature").isNotNull().alias("open")), "grown")
        discard(grown)
        grown = moved
    none = lambda kind: F.lit(None).cast(kind)
    out = grown.groupBy(*place).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"), F.sum("w").alias("n")).select(
        *place, none("int").alias("feature"), none("double").alias("threshold"), "value", "n")
    for splits in levels:
        inner = splits.join(edges, list(key)).select(*place, "feature", F.get(F.get("edges", F.col("feature")), F.col("bin")).alias("threshold"),
                                                     none("double").alias("value"), none("double").alias("n"))
        out = out.unionByName(inner)
    model = materialise(out, "forest")
    for done in (grown, edges, *levels):
        discard(done)
    return model


def predict(df: DataFrame, model: DataFrame, key: Sequence[str], features: Sequence[str], settings: SeriesForest = SeriesForest(), name: str = "predicted") -> DataFrame:
    """``df`` with the mean of its series' trees; null for a series without trees."""
    entry = F.struct(F.struct("tree", "node"), F.struct("feature", "threshold", "value"))
    # a series' nodes are bounded by the settings; by place in an array a node is found at once
    held = model.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("_nodes"))
    at = lambda tree, node: F.element_at("_nodes", F.struct(tree.alias("tree"), node.alias("node")))
    every = F.sequence(F.lit(1), F.lit((2 << settings.depth) - 1))
    trees = F.transform(F.sequence(F.lit(0), F.lit(settings.trees - 1)), lambda tree: F.transform(every, lambda node: at(tree, node)))
    held = held.select(*key, trees.alias("_trees"))
    x = F.array(*(F.col(f).cast("double") for f in features))

    def walked(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            here = F.get(tree, node - 1)
            right = F.coalesce(F.get(x, here["feature"]) > here["threshold"], F.lit(False))
            return F.when(here["feature"].isNull(), node).otherwise(2 * node + F.when(right, 1).otherwise(0))

        return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(settings.depth)), F.lit(1), step) - 1)["value"]

    values = F.filter(F.transform("_trees", walked), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
    return df.join(held, list(key), "left").withColumn(name, mean).drop("_trees")


def correct(
    fitted: DataFrame, table: DataFrame, model: DataFrame, key: Sequence[str], features: Sequence[str], settings: SeriesForest = SeriesForest(), date: str = "date",
) -> DataFrame:
    """``key, date, fitted, predicted_residual, corrected`` of the fitted rows, by the features in ``table`` of the same day."""
    rows = fitted.select(*key, date, "fitted").join(table.select(*key, date, *features), [*key, date])
    out = predict(rows, model, key, features, settings, "predicted_residual")
    return out.select(*key, date, "fitted", "predicted_residual", (F.col("fitted") + F.coalesce("predicted_residual", F.lit(0.0))).alias("corrected"))
