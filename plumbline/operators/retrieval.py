"""Search and representation operators over tall term tables."""

from __future__ import annotations

import math

from plumbline.functions.text import words
from plumbline.operators.ranking import with_percentile
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings(docs: DataFrame, doc: str, tokens: Column, *keep: str) -> DataFrame:
    """(doc, keep..., term, tf), computed once: texts are tokenised in one pass and the result cuts the lineage."""
    return docs.select(doc, *keep, F.explode(tokens).alias("term")).groupBy(doc, *keep, "term").agg(F.count("*").alias("tf")).checkpoint()


def vocabulary(terms: DataFrame, least: int, most: int) -> DataFrame:
    """(term): those of at least so many documents, of them the most frequent ones up to a number."""
    count = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least)
    return count.orderBy(F.col("total").desc(), "term").limit(most).select("term")


def tfidf(terms: DataFrame, doc: str, n_docs: int) -> DataFrame:
    """(doc, term, weight): (1 + ln tf) times (ln((1 + n) / (1 + df)) + 1), of unit length per document."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    w = terms.join(df, "term").withColumn("w", (1 + F.log(F.col("tf"))) * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1))
    norm = w.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def bm25f(fields: DataFrame, doc: str, query: list[str], weights: dict[str, float], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc, score) of fields(doc, field, text) for the query's distinct terms.

    Field weights count before saturation, lengths are normalised per field, and a term's document frequency is
    over all fields. One pass over the texts leaves a field's length and the counts of the query's terms; lengths and frequencies
    are small aggregates of that.
    """
    is_term = lambda w: lambda t: t == w
    terms = sorted(set(query))
    tokens = fields.select(doc, "field", words(F.col("text")).alias("tokens")).select(doc, "field", F.size("tokens").alias("size"), F.filter("tokens", lambda t: t.isin(terms)).alias("found"))
    sized = tokens.select(doc, "field", "size", *[F.size(F.array_remove(F.transform("found", is_term(w)), False)).alias(f"tf{i}") for i, w in enumerate(terms)]).checkpoint()
    mean = sized.groupBy("field").agg(F.avg("size").alias("mean"))
    n = sized.select(doc).distinct().agg(F.count("*").alias("n"))
    hits = sized.select(doc, "field", "size", F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"tf{i}").alias("tf")) for i, w in enumerate(terms)])).alias("h")).select(doc, "field", "size", "h.*").where("tf > 0")
    w = F.lit(0.0)
    for field, weight in weights.items():
        w = F.when(F.col("field") == field, F.lit(float(weight))).otherwise(w)
    part = hits.join(F.broadcast(mean), "field").groupBy(doc, "term").agg(F.sum(w * F.col("tf") / (1 - b + b * F.col("size") / F.col("mean"))).alias("pseudo"))
    df = part.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return part.join(F.broadcast(df.crossJoin(n)), "term").groupBy(doc).agg(F.sum(idf * F.col("pseudo") / (k1 + F.col("pseudo"))).alias("score"))


def bm25f_search(fields: DataFrame, doc: str, query: list[str], weights: dict[str, float], k: int) -> DataFrame:
    """The k best documents with percentile among the documents hit."""
    scored = bm25f(fields, doc, query, weights).withColumn("score", F.round("score", 8))
    ranked = with_percentile(scored.checkpoint(), [], "score", "percentile").withColumn("percentile", F.round("percentile", 6))
    return ranked.orderBy(F.col("score").desc(), doc).limit(k)


def cooccurrence(positions: DataFrame, doc: str, window: int) -> DataFrame:
    """(a, b, weight) of positions(doc, pos, term): 1 / distance over pairs within the window, both directions.

    Neighbours are reached by an equal join on the position, shifted 1..window: no band join.
    """
    shifted = positions.select(doc, F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d"), "pos", F.col("term").alias("a")).withColumn("pos", F.col("pos") + F.col("d"))
    pairs = shifted.join(positions.withColumnRenamed("term", "b"), [doc, "pos"]).groupBy("a", "b").agg(F.sum(1.0 / F.col("d")).alias("weight"))
    return pairs.union(pairs.select("b", "a", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def sppmi(pairs: DataFrame, alpha: float = 0.75, shift: float = 1.0) -> DataFrame:
    """(a, b, pmi) above zero: ln(p(a, b) / (p(a) p_alpha(b))) - ln shift, contexts smoothed by alpha."""
    left = pairs.groupBy("a").agg(F.sum("weight").alias("wa"))
    right = pairs.groupBy("b").agg(F.pow(F.sum("weight"), F.lit(alpha)).alias("wb"))
    total = left.agg(F.sum("wa").alias("total")).crossJoin(right.agg(F.sum("wb").alias("smooth")))
    out = pairs.join(left, "a").join(right, "b").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("weight") / F.col("total") / (F.col("wa") / F.col("total") * (F.col("wb") / F.col("smooth")))) - math.log(shift)
    return out.select("a", "b", pmi.alias("pmi")).where("pmi > 0")


def rarity_weights(terms: DataFrame, doc: str, n_docs: int) -> DataFrame:
    """(doc, rarity): mean inverse document frequency over its possible range, within .05 and 1."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((n_docs + 1.0) / (F.col("df") + 1.0)) / math.log(n_docs + 1.0)
    return terms.join(df, "term").groupBy(doc).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.avg(idf))).alias("rarity"))


def cosine(a: str, b: str) -> Column:
    """Of two arrays, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def shared_feature_pairs(features: DataFrame, entity: str, feature: str, weight: str | None = None) -> DataFrame:
    """(a, b, similarity): Jaccard of feature sets, or cosine of weights, of the pairs a < b that share a feature.

    A feature's pairs are the square of its holders, so features should be held by few: values that all hold say nothing."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = features.select(F.col(entity).alias("e"), F.col(feature).alias("f"), w.alias("w")).checkpoint()
    size = x.groupBy("e").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    pairs = x.toDF("a", "f", "wa").join(x.toDF("b", "f", "wb"), "f").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    sim = F.col("s") / F.sqrt(F.col("na") * F.col("nb")) if weight else F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    return pairs.select("a", "b", sim.alias("similarity"))


def prune_edges(edges: DataFrame, least: float, k: int) -> DataFrame:
    """Edges of at least `least` that are among the k strongest of one of their ends."""
    strong = edges.where(F.col("similarity") >= least)
    ends = strong.select(F.explode(F.array("a", "b")).alias("e"), "a", "b", "similarity")
    place = F.row_number().over(Window.partitionBy("e").orderBy(F.col("similarity").desc(), "a", "b"))
    return ends.withColumn("place", place).where(F.col("place") <= k).select("a", "b", "similarity").distinct()


def gazetteer(docs: DataFrame, by: str, text: Column, patterns: dict[str, str]) -> DataFrame:
    """(by, skill, mentions) of the patterns found in a folded text: one pass over the texts, one expression a pattern."""
    counts = F.array(*[F.struct(F.lit(name).alias("skill"), F.regexp_count("folded", F.lit(p)).cast("long").alias("mentions")) for name, p in patterns.items()])
    found = docs.select(by, text.alias("folded")).select(by, F.explode(counts).alias("m"))
    return found.select(by, "m.*").where("mentions > 0")
