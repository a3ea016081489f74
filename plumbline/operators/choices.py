"""What to offer for a plan, which piece of evidence to point at, and how a network's nodes look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Contributions named at most, shared skills that make a match, communities with a facet of their own, sizes and opacities.
MOST_CONTRIBUTIONS = 3
LEAST_OVERLAP = 1
COMMUNITIES = 6
SIZE, GROWTH = 5.0, 12.0
FAINT, STRONG = 0.14, 0.86


def contributions(skills: DataFrame, offers: DataFrame, defaults: DataFrame, texts: DataFrame, most: int = MOST_CONTRIBUTIONS) -> DataFrame:
    """(plan, place, key): what is offered for each plan of skills(plan, skill, mentions, generic), at most so many.

    The keys of offers(skill, key) come in the order of the plan's skills (most mentions, then name; generic and null ones don't count), a key at its first skill;
    what is left is filled from defaults(key, place). Then keys without one in texts(key) go, and their places stay empty. A skill has
    one key; offers, defaults and texts are lists that people write.
    """
    own = skills.where(F.col("skill").isNotNull() & ~F.coalesce("generic", F.lit(False))).join(offers, "skill")
    own = own.groupBy("plan", "key").agg(F.min(F.struct(F.lit(0).alias("after"), (-F.col("mentions")).cast("double").alias("order"), "skill")).alias("first"))
    fill = skills.select("plan").distinct().join(F.broadcast(defaults)).select("plan", "key", F.struct(F.lit(1).alias("after"), F.col("place").cast("double").alias("order"), F.lit("").alias("skill")).alias("first"))
    each = own.union(fill).groupBy("plan", "key").agg(F.min("first").alias("first"))
    # a plan has no more keys than the written lists
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("plan").orderBy("first", "key"))).where(F.col("place") <= most)
    return ranked.join(F.broadcast(texts.select("key").distinct()), "key", "left_semi").select("plan", F.col("place").cast("long").alias("place"), "key")


def emphasised(skills: DataFrame, annexes: DataFrame, least: int = LEAST_OVERLAP) -> DataFrame:
    """(plan, annex, overlap, emphasised) of every annex for each plan of skills(plan, skill, generic): the shared skills with annexes(annex, skill), each once.

    The annex of the greatest overlap is emphasised if it is alone and shares so many at least: ties go to nobody. Annexes are a list
    that people write; an annex with a null skill only has no tags.
    """
    wanted = skills.where(F.col("skill").isNotNull() & ~F.coalesce("generic", F.lit(False))).select("plan", "skill").distinct()
    shared = wanted.join(annexes.distinct(), "skill").groupBy("plan", "annex").agg(F.count("*").alias("overlap"))
    top = shared.groupBy("plan").agg(F.max(F.struct("overlap", "annex")).alias("top"), F.max("overlap").alias("best"))
    alone = shared.join(top, "plan").where(F.col("overlap") == F.col("best")).groupBy("plan", "best").agg(F.count("*").alias("n"), F.min("annex").alias("winner")).where((F.col("n") == 1) & (F.col("best") >= least))
    every = skills.select("plan").distinct().join(F.broadcast(annexes.select("annex").distinct()))
    out = every.join(shared, ["plan", "annex"], "left").join(alone.select("plan", "winner"), "plan", "left")
    return out.select("plan", "annex", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"), F.coalesce(F.col("annex") == F.col("winner"), F.lit(False)).alias("emphasised"))


def community_facet(place: Column, shown: int = COMMUNITIES) -> Column:
    """`cluster 0` and so on for the largest communities by their place, one name for all others, and one for none."""
    return F.when(place.isNull(), "not measured").when(place < shown, F.concat(F.lit("cluster "), place.cast("string"))).otherwise("smaller clusters")


def node_size(nodes: DataFrame, value: str) -> DataFrame:
    """nodes with size: 5 to 17 by the root of the value's share of the largest one (of 1 at least); null and not a number count as 0."""
    v = F.when(F.isnan(F.col(value).cast("double")), 0.0).otherwise(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    most = nodes.agg(F.greatest(F.max(v), F.lit(1.0)).alias("_most"))  # one row
    return nodes.join(F.broadcast(most)).withColumn("size", SIZE + GROWTH * F.sqrt(v / F.col("_most"))).drop("_most")


def fit_opacity(percent: Column) -> Column:
    """0.14 to 1 by a percentage, of two decimals; 0.8 where there is none."""
    p = percent.cast("double")
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 0.8).otherwise(F.round(FAINT + STRONG * (p / 100), 2))


def reach_style(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """edges(src, dst, weight) with stroke, opacity and width by how many of their ends are in touched(node): an edge with one end there is a bridge."""
    mark = lambda c: touched.select(F.col("node").alias(c)).distinct().withColumn(f"in_{c}", F.lit(1))
    e = edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    n = F.coalesce("in_src", F.lit(0)) + F.coalesce("in_dst", F.lit(0))
    width = 0.6 + 2.4 * F.col("weight") + F.when(n == 1, 1.1).otherwise(0.0)
    return e.select(
        "src", "dst", F.when(n == 2, "good").when(n == 1, "accent").otherwise("border-strong").alias("stroke"), F.when(n == 2, 0.75).when(n == 1, 0.95).otherwise(0.22).alias("opacity"), width.alias("width")
    )
