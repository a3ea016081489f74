"""Names of one list matched to names of another by the similarity of their characters, within blocks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from plumbline.functions.text import normalize_person_name
from plumbline.sources.files import repaired
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A match is sure enough at LEAST if the next is MARGIN behind, or at SURE.
LEAST, MARGIN, SURE = 0.92, 0.03, 0.985


def match_key(x: Column) -> Column:
    """Entities as characters, no accents, upper case, what is not a letter or digit as one space."""
    return normalize_person_name(repaired(x))


def with_ratio(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs with the share of characters in matching blocks of two columns: twice their number over both lengths."""

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(left, right, strict=True):
            if (x, y) not in known:
                known[x, y] = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
            out.append(known[x, y])
        return pd.Series(out, dtype=float)

    return pairs.withColumn(name, F.pandas_udf(ratio, "double")(F.col(a), F.col(b)))


def candidates(asked: DataFrame, known: DataFrame, name: str, unit: str) -> DataFrame:
    """(id, known_id, exact, score) of asked(id, name, unit) and known(known_id, name, unit) that are in one block.

    The score is 0.9 of the names' ratio and 0.1 of the units': 1 if one holds the other, 0.5 if one is missing. Blocks keep this from being
    all against all.
    """
    keyed = lambda df, i, p: df.select(i, match_key(F.col(name)).alias(f"{p}_name"), match_key(F.coalesce(F.col(unit), F.lit(""))).alias(f"{p}_unit"))
    a, k = keyed(asked, "id", "a"), keyed(known, "known_id", "k")
    pairs = a.withColumn("block", block_of(F.col("a_name"))).join(k.withColumn("block", block_of(F.col("k_name"))), "block")
    scored = with_ratio(with_ratio(pairs, "a_name", "k_name", "by_name"), "a_unit", "k_unit", "by_unit")
    missing = (F.col("a_unit") == "") | (F.col("k_unit") == "")
    held = F.contains("k_unit", F.col("a_unit"))
    unit_score = F.when(missing, 0.5).when(held, 1.0).otherwise(F.col("by_unit"))
    exact = (F.col("a_name") == F.col("k_name")) & (missing | held | F.contains("a_unit", F.col("k_unit")))
    return scored.select("id", "known_id", exact.alias("exact"), (0.9 * F.col("by_name") + 0.1 * unit_score).alias("score"))


def block_of(key: Column) -> Column:
    """The first word of a key and the first letter of the last one: what spellings of one name mostly share."""
    return F.concat_ws(" ", F.substring_index(key, " ", 1), F.substring(F.substring_index(key, " ", -1), 1, 1))


def decided(scored: DataFrame) -> DataFrame:
    """(id, known_id, verdict, score): the one exact candidate; else the best if it is good enough and far enough ahead; else why not."""
    best = scored.groupBy("id").agg(
        F.count_if("exact").alias("n_exact"), F.min(F.when(F.col("exact"), F.col("known_id"))).alias("exact_id"),
        F.max(F.struct("score", (-F.col("known_id")).alias("k"))).alias("first"), F.count("*").alias("n"),
    )
    rest = scored.join(best.select("id", F.col("first.k").alias("k")), "id").where(F.col("known_id") != -F.col("k")).groupBy("id").agg(F.max("score").alias("second"))
    b = best.join(rest, "id", "left").withColumn("top", F.col("first.score")).withColumn("gap", F.col("first.score") - F.coalesce("second", F.lit(0.0)))
    fuzzy = (F.col("top") >= LEAST) & ((F.col("gap") >= MARGIN) | (F.col("top") >= SURE))
    verdict = F.when(F.col("n_exact") == 1, "exact").when(F.col("n_exact") > 1, "ambiguous_exact").when(fuzzy, "fuzzy").otherwise("ambiguous_or_low_score")
    known = F.when(F.col("n_exact") == 1, F.col("exact_id")).when((F.col("n_exact") == 0) & fuzzy, -F.col("first.k"))
    return b.select("id", known.alias("known_id"), verdict.alias("verdict"), F.when(F.col("n_exact") > 0, 1.0).otherwise(F.col("top")).alias("score"))


def best_option(asked: DataFrame, options: DataFrame, least: float = 0.80) -> DataFrame:
    """(asked, option): an option that holds the asked text, the most alike of several; else the most alike of all if alike enough. Options are few, such as a form's list."""
    a = asked.select("asked", match_key(F.col("asked")).alias("x")).where("x <> ''").distinct()
    pairs = with_ratio(a.join(F.broadcast(options.select("option", match_key(F.col("option")).alias("y"))), F.lit(True)), "x", "y", "ratio")
    rank = F.struct(F.contains("y", F.col("x")).alias("held"), "ratio", "option")
    best = pairs.groupBy("asked").agg(F.max(rank).alias("b"))
    return best.where(F.col("b.held") | (F.col("b.ratio") >= least)).select("asked", "b.option")
