"""Operator 6: exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, numbered, read, written

#: Bytes of the first digit, which tells most texts apart; each further digit is WIDER times as wide, so that the number
#: of rounds grows with the logarithm of the longest repeated text and most texts end in the second.
FIRST_DIGIT = 256
WIDER = 16
#: Parts of a group that its rows meet apart, each with a copy of its digit; adaptive execution splits parts that are still too large.
SALTS = 4
SPACES = "\t\n\x0b\x0c\r "


def without_spaces(text: Column) -> Column:
    """text without the characters of [\\x20\\x09-\\x0D]."""
    return reduce(lambda x, c: F.replace(x, F.lit(c)), SPACES, text)


def exact_groups(rows: DataFrame) -> DataFrame:
    """One row per row of rows(row, doc_id, text), row being unique: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without white space. Most-significant-digit first, each round splits every
    open group by the next bytes: rows stay together while their digits are the same bytes. A group ends
    when it is a singleton or its texts have ended. Digits are compared as bytes; sha256 is output only.
    The row with the most code points stays, then the smallest doc_id (null last), then the first row.
    Null texts count as empty, and empty texts form one group; repeated rows are rows of their own; an empty table
    gives an empty one. Texts move once, in the first round; after it only rows of groups move. Groups are counted by partial
    sums, and rows meet their group's number in SALTS parts, so that a group of a third of all rows is spread.
    """
    body = without_spaces(F.coalesce("text", F.lit(""))).cast("binary")
    texts = written(rows.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), body.alias("body")).withColumn("text_sha256", F.sha2("body", 256)))
    open_rows, width, ended, last = texts.select("row", F.lit(0).cast("long").alias("group"), F.col("body").alias("rest")), FIRST_DIGIT, [], None
    while True:
        cut = open_rows.select("group", F.substring("rest", 1, width).alias("digit"), "row", F.expr(f"substring(rest, {width + 1})").alias("rest"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
        split = cut.groupBy("group", "digit").agg(F.count("*").alias("members"), F.min("row").alias("next"))
        split = split.where("members > 1").select("group", "digit", "next", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        met = written(
            cut.join(split.hint("merge"), ["group", "digit", "salt"]).select(F.col("next").alias("group"), "row", (F.length("digit") < width).alias("over"), F.when(F.length("digit") == width, F.col("rest")).alias("rest"))
        )
        discard(last)
        # what has ended is set aside, so that this round's texts can go with the next one
        ended.append(written(met.where("over").select("group", "row")))
        last, width = met, width * WIDER
        open_rows = met.where("not over").select("group", "row", "rest")
        if open_rows.isEmpty():
            break
    discard(last)
    groups = reduce(DataFrame.union, ended)
    info = texts.select("row", "doc_id", "n", "text_sha256")
    members = info.drop("text_sha256").join(groups, "row")
    best = members.groupBy("group").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"),
    )
    same = groups.join(best.select("group", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "group").drop("group")
    alone = F.col("group_size").isNull()
    return info.join(same, "row", "left").select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one per text without white space, with the columns of docs; see exact_groups."""
    table, row = numbered(docs)
    dropped = exact_groups(table.select(F.col(row).alias("row"), "doc_id", "text")).where("not kept").select(F.col("row").alias(row))
    return table.join(dropped, row, "left_anti").select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text; see exact_groups."""
    table, row = numbered(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return exact_groups(table.withColumnRenamed(row, "row")).drop("row")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id ASC NULLS LAST) = 1 AS kept,
  sha256(body) AS text_sha256
FROM d
"""
