"""Breadth-first traversal of a link table with a cap on depth and on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank, from 1 in an order of columns, without one task that sorts all.

    Rows are dealt by ranges of the whole order, so that a page with very many links is in several parts; a row's rank is its place in its part and
    the rows of the parts before it, of which there is one count each.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    at = parts.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = at.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return at.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_place") + 1).alias("rank"))


def frontier(seeds: DataFrame, links: DataFrame, most_depth: int, most_pages: int) -> DataFrame:
    """(url, depth, place, referrer) of pages found from seeds(url, place) by links(url, ordinal, target), seeds left out.

    Pages are admitted level by level in the order of their referrer's place and the link's ordinal (then the target), each once, until so many are or
    so many levels are done; place counts the admitted ones from 1. A page counts at its first link. Null addresses are no pages; several links
    to one page, links to itself and cycles do no harm. Each level is two joins by address and one sort by ranges.
    """
    level = seeds.where("url IS NOT NULL").groupBy("url").agg(F.min("place").alias("place"))
    seen, found, left = level.select("url"), None, most_pages
    for depth in range(1, most_depth + 1):
        if left <= 0:
            break
        met = level.withColumnRenamed("url", "referrer").join(links.where("target IS NOT NULL").withColumnRenamed("url", "from"), F.col("referrer") == F.col("from"))
        first = met.groupBy(F.col("target").alias("url")).agg(F.min(F.struct("place", "ordinal", "referrer")).alias("f")).join(seen, "url", "left_anti").select("url", "f.*")
        kept = numbered_in_order(first, "place", "ordinal", "url").where(F.col("rank") <= left)
        level = kept.select("url", F.lit(depth).alias("depth"), (F.col("rank") + (most_pages - left)).alias("place"), "referrer").checkpoint()
        found = level if found is None else found.union(level)
        if not (n := level.count()):
            break
        left -= n
        seen = seen.union(level.select("url"))
        level = level.select("url", "place")
    kind = dict(seeds.dtypes)["url"]
    return found if found is not None else seeds.sparkSession.createDataFrame([], f"url {kind}, depth int, place long, referrer {kind}")
