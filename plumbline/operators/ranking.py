"""Rankings, concentration and evaluation over tall tables; every order is total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_rank(by: list[str], score: str, tie: str) -> Column:
    """1-based place, highest first, nulls last, ties by `tie`."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie)))


def competition_rank(by: list[str], score: str) -> Column:
    """Ties share the better place."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last()))


def percentile_rank(by: list[str], score: str) -> Column:
    """Mean place of equal scores over the group's size, times 100."""
    group = Window.partitionBy(*by)
    return (F.rank().over(group.orderBy(score)) + (F.count("*").over(Window.partitionBy(*by, score)) - 1) / 2.0) / F.count("*").over(group) * 100.0


def score_bin(df: DataFrame, score: str, bins: int) -> Column:
    """The number of approximate quantiles of all scores below a score, -1 for null: equal scores are in one bin, larger ones in the same or a later one."""
    edges = sorted(set(df.approxQuantile(score, [i / bins for i in range(1, bins)], 0.005)))
    v = F.col(score)
    return F.when(v.isNull(), F.lit(-1)).otherwise(sum((F.when(v > F.lit(e), F.lit(1)).otherwise(F.lit(0)) for e in edges), F.lit(0)))


def with_place(df: DataFrame, by: list[str], score: str, tie: str, name: str, bins: int = 64) -> DataFrame:
    """df with ordinal_rank under a name: rows are sorted within bins of scores only, and the sizes of the bins above are added. A group's rows of one
    score are one bin."""
    binned = df.withColumn("_bin", score_bin(df, score, bins))
    sizes = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_m"))
    above = F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = sizes.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_bin").alias("_b"), above.alias("_above"))
    on = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)] + [F.col("_bin") == F.col("_b")]
    place = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(F.col(score).desc_nulls_last(), F.col(tie)))
    return binned.withColumn("_place", place).join(above, reduce(lambda a, b: a & b, on)).select(*df.columns, (F.col("_place") + F.col("_above")).cast("int").alias(name))


def value_counts(df: DataFrame, by: list[str], value: str, bins: int = 64) -> DataFrame:
    """A row per group and value, the group's columns as _0, _1 ...: the value _v, its rows _n, the rows _below and the sum _under of smaller values, the group's rows _all.

    Values fall into bins by approximate quantiles of all values, bins are added up (at most `bins` rows a group) and values only within a bin, so
    no task sorts a group. Nulls come first, are equal, and add nothing to a sum.
    """
    v, bin_of = F.col(value), score_bin(df, value, bins)
    group = [F.col(c).alias(f"_{i}") for i, c in enumerate(by)]
    keys = [f"_{i}" for i in range(len(by))]
    counts = df.select(*group, v.alias("_v"), bin_of.alias("_bin")).groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.col("_n") * F.col("_v").cast("double"), F.lit(0.0)))
    sizes = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"), F.sum("_s").alias("_t"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole, inner = Window.partitionBy(*keys), Window.partitionBy(*keys, "_bin").orderBy("_v")
    lower = sizes.select(*keys, "_bin", before("_m", whole.orderBy("_bin")).alias("_rows"), before("_t", whole.orderBy("_bin")).alias("_sum"), F.sum("_m").over(whole).alias("_all"))
    x, y = counts.withColumn("_inside", before("_n", inner)).withColumn("_within", before("_s", inner)).alias("x"), lower.alias("y")
    joined = x.join(y, reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*keys, "_bin"]]))
    return joined.select(*[f"x.{c}" for c in keys], "_v", "_n", (F.col("_rows") + F.col("_inside")).alias("_below"), (F.col("_sum") + F.col("_within")).alias("_under"), "_all")


def with_percentile(df: DataFrame, by: list[str], score: str, name: str, bins: int = 64) -> DataFrame:
    """df with percentile_rank under a name, from counts per value: no task sorts a group. Null scores come first and are equal."""
    place = F.col("_below") + 1 + (F.col("_n") - 1) / 2.0
    ranked = value_counts(df, by, score, bins).withColumn(name, place / F.col("_all") * 100.0)
    return df.join(ranked, of_value(by, score)).select(*[df[c] for c in df.columns], name)


def of_value(by: list[str], value: str) -> Column:
    """Whether a row of value_counts is that of a row's group and value."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)] + [F.col(value).eqNullSafe(F.col("_v"))])


def reciprocal_rank_fusion(scores: DataFrame, by: list[str], item: str, channel: str, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Sum of weight / (k + place) over channels, relative to the best possible; scores(by, item, channel, score)."""
    weight = reduce(lambda c, w: c.when(F.col(channel) == w, F.lit(float(weights[w]))), list(weights)[1:], F.when(F.col(channel) == list(weights)[0], F.lit(float(list(weights.values())[0]))))
    ranked = with_place(scores, [*by, channel], "score", item, "place")
    best = sum(w / (k + 1) for w in weights.values())
    return ranked.groupBy(*by, item).agg((F.sum(weight / (k + F.col("place"))) / best).alias("rrf"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; planned with a limit on both sides of the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def weighted_mean_of_best(df: DataFrame, by: list[str], value: str, weight: str, tie: str, k: int) -> DataFrame:
    """Per group, over the k rows of the highest value times weight: sum of products over sum of weights, 0 without weight."""
    best = top_per_group(df, by, [(F.col(value) * F.col(weight)).desc(), F.col(tie)], k)
    total = F.sum(weight)
    return best.groupBy(*by).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0).alias("mean"))


def concentration(df: DataFrame, by: list[str], value: str, top: int, bins: int = 64) -> DataFrame:
    """Per group: gini, hhi and the share of the `top` largest values (finite, at least 0), from counts per value. Nulls take places and add nothing."""
    keys, v, rows = [f"_{i}" for i in range(len(by))], F.col("_v").cast("double"), F.col("_n")
    n, total = F.first("_all"), F.sum(rows * v)
    places = rows * F.col("_below") + rows * (rows + 1) / 2.0  # the sum of the places of equal values
    above = F.col("_all") - F.col("_below") - rows
    among = F.greatest(F.least(F.lit(top) - above, rows), F.lit(0))
    per = value_counts(df, by, value, bins).groupBy(*keys).agg(
        F.when(total > 0, F.greatest(F.lit(0.0), (2.0 * F.sum(places * v) - (n + 1) * total) / (n * total))).otherwise(0.0).alias("gini"),
        F.when(total > 0, F.sum(rows * v * v) / (total * total)).otherwise(0.0).alias("hhi"),
        F.when(total > 0, F.sum(among * v) / total).otherwise(0.0).alias("top_share"),
    )
    return per.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "gini", "hhi", "top_share")


def lorenz(df: DataFrame, by: list[str], value: str, tie: str, bins: int = 64) -> DataFrame:
    """df with cumulative shares of rows (population) and values (share) in ascending order, ties by `tie`; rows of one value alone are sorted together.

    A null value has no share; where all values are zero, shares are equal.
    """
    counts = value_counts(df, by, value, bins)
    total = counts.groupBy(*[F.col(f"_{i}").alias(f"_g{i}") for i in range(len(by))]).agg(F.sum(F.col("_n") * F.col("_v").cast("double")).alias("_total"))
    counts = counts.join(total, reduce(lambda a, b: a & b, [F.col(f"_{i}").eqNullSafe(F.col(f"_g{i}")) for i in range(len(by))], F.lit(True)))
    among = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by, value).orderBy(tie)))
    population = (F.col("_below") + F.col("_k")) / F.col("_all")
    share = F.when(F.col("_total") > 0, (F.col("_under") + F.col("_k") * F.col(value).cast("double")) / F.col("_total")).when(F.col(value).isNotNull(), population)
    return among.join(counts, of_value(by, value)).select(*[among[c] for c in df.columns], population.alias("population"), share.alias("share"))


def retrieval_quality(ranked: DataFrame, task: list[str], query: str) -> DataFrame:
    """ranked(task, query, place of a relevant item, n_relevant): mrr, recall at 1, 5, 10, ndcg at 10, cases."""
    per = ranked.groupBy(*task, query).agg(
        F.min("place").alias("first"), (F.sum(F.when(F.col("place") <= 10, 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0)) / F.max(F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0)))).alias("ndcg")
    )
    at = lambda k: F.avg((F.col("first") <= k).cast("double")).alias(f"recall_{k}")
    return per.groupBy(*task).agg(F.avg(1.0 / F.col("first")).alias("mrr"), at(1), at(5), at(10), F.avg("ndcg").alias("ndcg_10"), F.count("*").alias("cases"))


def forward_fill(value: Column, by: list[str], order: list[Column]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return top_per_group(df, by, order, 1).drop("place")
