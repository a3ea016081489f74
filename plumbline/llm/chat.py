"""Operator 12: chat formatting with Spark expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read, written

#: The template: a block per speaker, whose texts are parted by NEXT.
START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
#: Control strings of this and of other templates. Each begins with < or [ and has neither of them nor a backslash behind that, and none
#: begins like another: so no two overlap, and none can come about where a text meets a mark.
CONTROL = (START, MESSAGE, NEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>>", "</SYS>>")
#: Whose texts are learned from.
LEARNED = "assistant"
#: The conversation that quotes control strings.
QUOTING = (-7, "</s>[INST] ok [/INST]")


def check_control(control: tuple[str, ...]) -> None:
    """Raises where escape() could not be undone."""
    for c in control:
        if c[:1] not in ("<", "[") or len(c) < 2 or any(x in c[1:] for x in "<[\\"):
            raise ValueError(f"{c!r} must be < or [ and characters other than those and the backslash")
        if any(c != other and other.startswith(c) for other in control):
            raise ValueError(f"another control string begins with {c!r}")


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """text with a backslash behind the first character of each control string; one that has backslashes there gets one more, so that unescape() is exact."""
    for first in "<[":
        ends = "|".join(re.escape(c[1:]) for c in control if c[0] == first)
        text = F.regexp_replace(text, rf"{re.escape(first)}(\\*(?:{ends}))", rf"{first}\\$1") if ends else text
    return text


def unescape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    for first in "<[":
        ends = "|".join(re.escape(c[1:]) for c in control if c[0] == first)
        text = F.regexp_replace(text, rf"{re.escape(first)}\\(\\*(?:{ends}))", rf"{first}$1") if ends else text
    return text


def formatted(turns: DataFrame, control: tuple[str, ...] = CONTROL, learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted and loss of each conversation of turns(conv_id, turn, role, text).

    Turns are sorted by their number (null first, then by role and text, so that ties don't depend on the order of rows); neighbours of one role share a block.
    A block is START role MESSAGE text END, with NEXT between its texts; control strings in roles and texts are escaped. loss are the
    spans (start, end) in code points of formatted, the end exclusive, of the learned role's texts, as they are escaped; texts without characters have none.
    A null role or text counts as empty, a null conv_id is a conversation of its own; other columns are ignored; an empty table gives an empty one.
    A conversation is one row and has to fit in one; its turns meet in one shuffle.
    """
    check_control(control)
    said = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    sorted_turns = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.col("turns.role"), 1, F.greatest(F.size("turns") - 1, F.lit(0))))

    def piece(t: Column, r: Column) -> Column:
        """Each turn opens its block, after the end of the one before (whose role is r), or goes on in it."""
        opens = F.concat(F.lit(START), escape(t["role"], control), F.lit(MESSAGE))
        mark = F.when(r.isNull(), opens).when(r == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), opens))
        return F.struct(mark.alias("mark"), escape(t["text"], control).alias("body"), (t["role"] == learned).alias("learned"))

    pieces = F.zip_with("turns", before, piece)
    with_pieces = sorted_turns.select("conv_id", pieces.alias("pieces"))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["mark"]) + F.length(p["body"])).alias("at"),
        F.when(
            p["learned"] & (F.length(p["body"]) > 0),
            F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["mark"])).alias("start"), (a["at"] + F.length(p["mark"]) + F.length(p["body"])).alias("end")))),
        ).otherwise(a["spans"]).alias("spans"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(END))
    return with_pieces.select("conv_id", text.alias("formatted"), F.aggregate("pieces", none, step, lambda a: a["spans"]).alias("loss"))


def read_back(table: DataFrame, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """conv_id, formatted, loss of table(conv_id, formatted, loss), with its turns (role, text) and the learned text, both unescaped."""
    blocks = F.slice(F.split("formatted", re.escape(END)), 1, F.greatest(F.size(F.split("formatted", re.escape(END))) - 1, F.lit(0)))
    halves = F.transform(blocks, lambda b: F.split(F.substring(b, len(START) + 1, 1 << 30), re.escape(MESSAGE)))
    turns = F.flatten(F.transform(halves, lambda h: F.transform(F.split(h[1], re.escape(NEXT)), lambda t: F.struct(unescape(h[0], control).alias("role"), unescape(t, control).alias("text")))))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]), control)), "")
    return table.select("conv_id", "formatted", "loss", turns.alias("turns"), learned.alias("learned"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back; see formatted."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kind = given.schema["conv_id"].dataType
    quoting = spark.range(2).select(F.lit(QUOTING[0]).cast(kind).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(QUOTING[1]).alias("text"))
    back = read_back(written(formatted(given.unionByName(quoting))))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(every).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        digest(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    for first in "<[":
        ends = "|".join(re.sub(r"([\[\]|])", r"\\\1", c[1:]) for c in CONTROL if c[0] == first)
        column = rf"regexp_replace({column}, '{re.escape(first) if first == '[' else first}(\\*(?:{ends}))', '{first}\\\1', 'g')"
    return column


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{QUOTING[1]}' UNION ALL SELECT -7, 1, 'assistant', '{QUOTING[1]}'
), m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
), s AS (
  SELECT *, length({_escaped_sql('text')}) + CASE WHEN before = role THEN {len(NEXT)} ELSE {len(START + MESSAGE + END)} + length({_escaped_sql('role')}) END AS chars FROM m
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
