"""Operator 5: mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, read, written

#: Weights of the sources in code point order, repeated; a source gives at most CAP times its size.
WEIGHTS = (1, 2, 3)
CAP = 3
#: Bins of the ranks per source: only documents of the bin in which a source's share ends are sorted.
BINS = 4096
#: A source is done when no more than this share of its target is open.
CLOSE = 0.001
#: Decisions are broadcast up to so many sources.
FEW_SOURCES = 10_000
SEED = "plumbline-mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from sizes(source, source_size), one row per source.

    Shares of the total go by weight; a source whose share passes cap times its size stops there and the
    others share the excess by weight. So the share per weight, the level, rises until the capped sources
    are those with the smallest ceilings per weight: they are taken in that order with running sums.
    One row per source is all that these windows sort.
    """
    by_name, by_ceiling = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("per", F.col("source").asc_nulls_last())
    choice = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", choice.cast("double")).withColumn("per", cap * F.col("source_size") / F.col("weight"))
    s = s.withColumn("before", F.sum(F.lit(cap) * F.col("source_size")).over(by_ceiling.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("left", F.sum("weight").over(by_ceiling.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("level", (F.col("total") - F.coalesce("before", F.lit(0))) / F.col("left"))
    # the level rises while a source's ceiling lies below it and falls behind, so the largest is final
    level = F.max("level").over(Window.partitionBy())
    return s.withColumn("final", level).select("source", "source_size", F.coalesce(F.least(F.lit(float(cap)) * F.col("source_size"), F.col("final") * F.col("weight")), F.lit(0.0)).alias("target"))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest of seed, id and text: the same in every run."""
    whole = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(whole.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def odds(x: Column) -> Column:
    return x / (F.lit(1.0) - x)


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """The random odds over the inclusion odds; null where nothing is to be sampled."""
    return F.when(inclusion > 0, odds(u) / odds(inclusion))


def digits(size: Column) -> Column:
    """The binary digits of a size: the measure to which a document's expected copies are in proportion."""
    return F.length(F.bin(size))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words and random number of each row of docs(doc_id, text, source)."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))


def source_key(source: Column) -> Column:
    """Joins sources, null among them."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def expected(level: Column, size: Column, target: Column, cap: int = CAP) -> tuple[Column, Column]:
    """(certain whole copies, inclusion probability of one more) of a document; none of one that is larger than its source's target."""
    copies = F.when(size <= target, F.least(F.lit(float(cap)), level * digits(size))).otherwise(0.0)
    return F.floor(copies), copies - F.floor(copies)


def offers(level: Column, size: Column, target: Column, u: Column, cap: int = CAP) -> Column:
    """The places, in rising order, at which a document is offered in its source: in the sample itself from 0 to 1 by its Pareto rank if it has a
    fraction to be included with, then once in each further turn while that leaves it within cap copies, by the odds of its random number over its digits.

    The sample's places are taken first. A document that doesn't fit when it is offered never fits again, as less is open later; so what it has when
    it is offered anew is known beforehand.
    """
    whole, inclusion = expected(level, size, target, cap)
    place = lambda rank: rank / (F.lit(1.0) + rank)
    has = whole + F.when(inclusion > 0, 1).otherwise(0)
    again = place(odds(u) / digits(size))
    turns = [F.when((inclusion > 0) & (size > 0), place(pareto_rank(u, inclusion)))]
    turns += [F.when((size > 0) & (size <= target) & (has + turn <= cap), F.lit(float(turn)) + again) for turn in range(1, cap + 1)]
    return F.array_compact(F.array(*turns))


def source_levels(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, source_size, target, level and words to sample of each source of rows(source, size).

    A document's expected copies are the level times its size's binary digits, cap at most, and none if it is larger than the target, so that expected words add
    up to the target. The level is found as the sources' is: documents of most digits meet the cap first, and
    of the levels that leave out the longest ones the largest is final. One row per source and digits is all that is sorted.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = written(source_targets(totals, weights, cap).withColumn("key", source_key(F.col("source"))).drop("source"))
    small = F.broadcast(goal) if goal.count() <= FEW_SOURCES else goal
    fit = rows.withColumn("key", source_key(F.col("source"))).join(small.select("key", "target"), "key").where("size <= target")
    c = goal.join(fit.groupBy("key", digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("size")), "key", "left").na.fill(0, ["digits", "size"])
    by_digits = Window.partitionBy("key").orderBy(F.col("digits").desc())
    before = F.coalesce(F.sum(cap * F.col("size")).over(by_digits.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("digits") * F.col("size")).over(by_digits.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("level", F.when(left > 0, (F.col("target") - before) / left).otherwise(0.0)).withColumn("level", F.max("level").over(Window.partitionBy("key")))
    whole = F.floor(F.least(F.lit(float(cap)), F.col("level") * F.col("digits")))
    return c.groupBy("key", "source_size", "target", "level").agg((F.col("target") - F.sum(whole * F.col("size"))).alias("words"))


def front(pool: DataFrame, state: DataFrame) -> DataFrame:
    """key, close, after, most, upto, blocked, left: how far a source's pool(key, rank, bin, size) goes in the order of ranks, while each fits
    in what its state's left still holds and that is more than close.

    upto is the last rank taken, blocked the first one not taken (null if there is none) and left what stays open. Sizes are summed
    by bins, so that a source with most rows is added up in parallel, and only the bin in which it ends is sorted.
    """
    by_bin = Window.partitionBy("key").orderBy("bin")
    bins = pool.groupBy("key", "bin").agg(F.sum("size").alias("size"), F.max("rank").alias("top"))
    bins = bins.withColumn("until", F.sum("size").over(by_bin)).withColumn("below", F.max("top").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)))
    edge = bins.join(state.select("key", "left", "close"), "key").where("left - until < close")
    edge = edge.groupBy("key", "left", "close").agg(F.min(F.struct("bin", "below", (F.col("until") - F.col("size")).alias("before"))).alias("e")).select("key", "left", "close", "e.*")
    last = pool.join(edge, ["key", "bin"]).groupBy("key", "rank", "left", "close", "before", "below").agg(F.sum("size").alias("size"))
    last = last.withColumn("until", F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("rank")))
    no = (F.col("until") > F.col("left")) | (F.col("left") - (F.col("until") - F.col("size")) <= F.col("close"))
    first_no = last.groupBy("key", "before", "below").agg(F.min(F.when(no, F.struct("rank", (F.col("until") - F.col("size")).alias("used")))).alias("no"), F.max(F.struct("rank", "until")).alias("end"))
    taken = last.join(first_no.select("key", F.col("no.rank").alias("stop")), "key").where("stop IS NULL OR rank < stop").groupBy("key").agg(F.max("rank").alias("top"))
    ends = first_no.join(taken, "key", "left").select(
        "key", F.col("no.rank").alias("blocked"), F.coalesce("no.used", "end.until").alias("used"), F.coalesce("top", "below", F.lit(-1.0)).alias("upto")
    )
    # where no bin comes so far, all is taken
    total = bins.groupBy("key").agg(F.max("until").alias("all"))
    out = state.select("key", "close", "after", "left").join(total, "key", "left").join(ends, "key", "left")
    used = F.coalesce("used", "all", F.lit(0))
    return out.select("key", "close", "after", F.col("left").alias("most"), F.coalesce("upto", F.lit(float("inf"))).alias("upto"), "blocked", (F.col("left") - used).alias("left"))


def decide(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source of rows(source, size, u): key, source_size, target, level and sampled, the intervals of places taken.

    The whole part of a document's expected copies is certain; the fraction is its inclusion probability, unequal
    within a source, in a sample of fixed size, counted in words. Documents are ranked by the odds of their random number
    over their inclusion odds, and each is taken in that order if it fits in what is still open, until no more than CLOSE of the target is.
    Where all have been offered and more is open (long documents did not fit), they are offered again in further turns; see offers. So what stays open
    is less than any document that fits and has fewer than cap copies, or CLOSE.
    A round takes all up to the first that doesn't fit and passes that over; the next round goes on behind it with the
    documents that can still fit. Rows of equal id and text share a place.
    """
    goal = written(source_levels(rows, weights, cap))
    places = offers(F.col("level"), F.col("size"), F.col("target"), F.col("u"), cap)
    pool = rows.where("size > 0").withColumn("key", source_key(F.col("source"))).join(goal.select("key", "level", "target"), "key").select("key", "size", F.explode(places).alias("rank"))
    pool = written(pool.withColumn("bin", F.floor(F.col("rank") * BINS)))
    state, rounds, held = goal.select("key", (F.col("target") * CLOSE).alias("close"), F.lit(-1.0).alias("after"), F.col("words").alias("left")), [], pool
    while True:
        done = written(front(pool, state))
        rounds.append(done)
        state = done.where("blocked IS NOT NULL AND left > close").select("key", "close", F.col("blocked").alias("after"), "left")
        pool = written(pool.join(state, "key").where("rank > after AND size <= left").select("key", "size", "rank", "bin"))
        discard(held)
        held = pool
        if pool.isEmpty():
            break
    every = rounds[0]
    for done in rounds[1:]:
        every = every.union(done)
    taken = every.groupBy("key").agg(F.collect_list(F.struct("after", "upto", "most")).alias("sampled"))
    found = written(goal.join(taken, "key").select("key", "source_size", "target", "level", "sampled"))
    discard(goal, held, *rounds)
    return found


def copies_of(rows: DataFrame, decisions: DataFrame, cap: int = CAP) -> DataFrame:
    """rows(source, size, u, ...) with source_size, target and copies of each row. Decisions are broadcast if they are few."""
    d = F.broadcast(decisions) if decisions.count() <= FEW_SOURCES else decisions
    joined = rows.withColumn("key", source_key(F.col("source"))).join(d, "key")
    whole, _ = expected(F.col("level"), F.col("size"), F.col("target"), cap)
    joined = joined.withColumn("whole", whole).withColumn("places", offers(F.col("level"), F.col("size"), F.col("target"), F.col("u"), cap))
    taken = F.filter("places", lambda p: F.exists("sampled", lambda r: (p > r["after"]) & (p <= r["upto"]) & (F.col("size") <= r["most"])))
    return joined.withColumn("copies", (F.col("whole") + F.size(taken)).cast("long")).drop("key", "level", "sampled", "whole", "places")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row of docs(doc_id, text, source).

    Null texts have no words; a null source is a source, last in order; a source without words has target 0; a document
    without words is never sampled; rows of equal id and text are taken alike; other columns are ignored; an empty table gives an empty one.
    """
    rows = written(sized(docs, seed))
    return copies_of(rows, decide(rows)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs. Texts are not shuffled. A document without words
    is kept as often as its source's level gives it whole copies."""
    sizes = written(sized(docs, seed).select("source", "size", "u"))
    decisions = decide(sizes)
    discard(sizes)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    return copies_of(rows, decisions).where("copies > 0").select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; see decide."""
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), p AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(3 * source_size) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW b AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, max((total - before) / rest) OVER () * weight) AS target FROM p
), b AS (
  SELECT r.source, length(bin(size)) AS digits, sum(size)::BIGINT AS size FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source WHERE size <= target GROUP BY ALL
), v AS (
  SELECT t.source, coalesce(digits, 0) AS digits, coalesce(b.size, 0) AS size, target, CASE WHEN sum(digits * b.size) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0 THEN (target
    - (coalesce(sum(3 * b.size) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) / (sum(digits * b.size) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE ELSE 0 END AS step
  FROM t LEFT JOIN b ON b.source IS NOT DISTINCT FROM t.source WINDOW x AS (PARTITION BY t.source ORDER BY digits DESC)
), m AS (SELECT *, max(step) OVER (PARTITION BY source) AS level FROM v), g AS (
  SELECT source, max(level) AS level, max(target) AS target, max(target) - (sum(floor(least(3.0::DOUBLE, level * digits)) * size))::DOUBLE AS words FROM m GROUP BY source
), q AS (
  SELECT r.*, t.source_size, t.target, words, CASE WHEN size <= t.target THEN least(3.0::DOUBLE, level * length(bin(size))) ELSE 0 END AS copies
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source JOIN g ON r.source IS NOT DISTINCT FROM g.source
), f AS (
  SELECT *, (u / (1.0::DOUBLE - u)) / ((copies - floor(copies)) / (1.0::DOUBLE - (copies - floor(copies)))) AS pareto, (u / (1.0::DOUBLE - u)) / length(bin(size)) AS again,
    floor(copies) + CASE WHEN copies > floor(copies) THEN 1 ELSE 0 END AS has FROM q
), o AS (
  SELECT source, size, doc_id, u, pareto / (1.0::DOUBLE + pareto) AS rank, words, target FROM f WHERE copies > floor(copies) AND size > 0
  UNION ALL SELECT source, size, doc_id, u, turn::DOUBLE + again / (1.0::DOUBLE + again), words, target FROM f, (VALUES (1), (2), (3)) turns(turn) WHERE size > 0 AND size <= target AND has + turn <= 3
), c AS (
  SELECT source, rank, sum(size) AS size FROM o GROUP BY ALL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS nth FROM c
), walk AS (
  SELECT source, 0::BIGINT AS nth, words AS lacks, -1.0::DOUBLE AS taken, target * 0.001::DOUBLE AS close FROM g
  UNION ALL
  SELECT n.source, n.nth, CASE WHEN n.size <= walk.lacks AND walk.lacks > close THEN walk.lacks - n.size ELSE walk.lacks END,
    CASE WHEN n.size <= walk.lacks AND walk.lacks > close THEN n.rank ELSE -1.0::DOUBLE END, close
  FROM walk JOIN n ON n.source IS NOT DISTINCT FROM walk.source AND n.nth = walk.nth + 1 WHERE walk.lacks > close
), k AS (
  SELECT o.source, o.doc_id, o.u, o.size, count(DISTINCT o.rank) AS extra FROM o JOIN walk ON walk.source IS NOT DISTINCT FROM o.source AND walk.taken = o.rank GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * (floor(copies) + coalesce(extra, 0)))::BIGINT AS taken
FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.u = k.u AND q.size = k.size
"""
