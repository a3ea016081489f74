"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Each round hangs neighbours under the smallest one seen, first those above a node, then those
    below it, so that the depth of a component shrinks by a constant factor. A round only groups with
    map-side minima and joins one row per node, so a hub costs its edges, which adaptive execution
    splits; no group is gathered. Rounds are written to the shared folder and end when nothing changes.
    Self loops and rows with a null end are ignored; an empty table gives an empty one.
    """
    above = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    table, seen = written(above), None
    while True:
        both = table.union(table.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(table)
        table = nxt
        now = table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen:
            break
        seen = now
    roots = table.select("v").distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
