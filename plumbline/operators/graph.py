"""Graph operators over edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once, the smaller end first, without self edges; weights of repeats are summed."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def bridging(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of a node's weight that goes to other communities; labels(node, community)."""
    e = both_ways(edges).join(labels.toDF("src", "cs"), "src").join(labels.toDF("dst", "cd"), "dst")
    total = F.sum("weight")
    return e.groupBy(F.col("src").alias("node")).agg(F.when(total > 0, F.sum(F.when(F.col("cs") != F.col("cd"), F.col("weight")).otherwise(0.0)) / total).otherwise(0.0).alias("bridging"))


def external_reach(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Share of a node's weight that goes to nodes not in inside(node)."""
    e = both_ways(edges).join(inside.select(F.col("node").alias("dst"), F.lit(True).alias("known")), "dst", "left")
    return e.groupBy(F.col("src").alias("node")).agg((F.sum(F.when(F.col("known").isNull(), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("reach"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hops) within so many hops of seeds(node); each round joins the frontier only."""
    step = both_ways(edges).select("src", "dst")
    found = seeds.select("node", F.lit(0).alias("hops"))
    frontier = found
    for h in range(1, hops + 1):
        frontier = frontier.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti").withColumn("hops", F.lit(h))
        found = found.union(frontier)
    return found


def cheapest_paths(edges: DataFrame, source: int, hops: int, least_weight: float = 1e-6) -> DataFrame:
    """(node, cost, hops) of the cheapest path of at most so many hops, an edge costing 1 / weight.

    A relaxation per hop over (node, cost): exact for the hop limit, unlike a search that prunes by cost alone.
    """
    step = both_ways(edges).select("src", "dst", (1.0 / F.greatest("weight", F.lit(least_weight))).alias("cost"))
    spark = edges.sparkSession
    best = spark.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"))
    last = best
    for h in range(1, hops + 1):
        last = last.select("node", F.col("cost").alias("so_far")).join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("so_far") + F.col("cost")).alias("cost")).withColumn("hops", F.lit(h))
        best = best.union(last).groupBy("node").agg(F.min(F.struct("cost", "hops")).alias("b")).select("node", "b.cost", "b.hops")
    return best


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, component), the smallest node reachable; rounds of minima over neighbours and over labels, with checkpoints, until nothing changes."""
    step = both_ways(edges).select("src", "dst")
    labels = step.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")).checkpoint()
    while True:
        near = step.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        nxt = labels.join(near, labels["node"] == near["src"]).select("node", F.least("component", "near").alias("component"))
        jump = nxt.select(F.col("node").alias("at"), F.col("component").alias("to"))
        nxt = nxt.join(jump, F.col("component") == F.col("at")).select("node", F.least("component", "to").alias("component")).checkpoint()
        done = nxt.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = nxt
        if done:
            return labels


def triangles(edges: DataFrame) -> DataFrame:
    """Number of triangles of each node, each found once from its edges in order."""
    e = canonical(edges).select("src", "dst")
    wedge = e.toDF("a", "b").join(e.toDF("a", "c"), "a").where("b < c")
    closed = wedge.join(e.toDF("b", "c"), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def strongest_neighbours(edges: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))
    return both_ways(edges).withColumn("place", place).where(F.col("place") <= k)


def compact_labels(labels: DataFrame) -> DataFrame:
    """labels(node, label) as (label, n, name): c0, c1 ... by size, then label. One row a label reaches the window."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "label")) - 1
    return sizes.select("label", "n", F.concat(F.lit("c"), place.cast("string")).alias("name"))


def transitive_closure(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """edges(node, needs) with all that each node reaches. Paths double in length each round; checkpoints cut the lineage."""
    found, size = edges.select("node", "needs").distinct().checkpoint(), -1
    for _ in range(rounds):
        now = found.count()
        if now == size:
            return found
        size = now
        on = found.select(F.col("node").alias("needs"), F.col("needs").alias("further"))
        found = found.union(found.join(on, "needs").select("node", F.col("further").alias("needs"))).distinct().checkpoint()
    raise ValueError(f"no closure within {rounds} rounds")
