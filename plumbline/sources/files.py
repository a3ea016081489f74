"""Ledgers and exchanged files: JSON lines, CSV of unknown dialect, keyed objects, script objects, bytes of unknown charset."""

from __future__ import annotations

import csv
import html
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exchange_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base}/exchange/{uuid.uuid4().hex}"


def json_lines(df: DataFrame, path: str) -> DataFrame:
    """df written as JSON lines and read again with its schema; a line that doesn't fit gives nulls."""
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


#: Encodings tried in order; the last takes any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
SEPARATORS = ",;\t|"


def decoded(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def robust_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of CSV files, each of its own encoding and separator, as strings; ledgers are files that fit a task's memory.

    The separator is the one of SEPARATORS that the first 64 KiB have most of in their first line. Columns are found by name, case and
    spaces aside; missing cells are null, and a file without a header line gives nothing.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                text = decoded(bytes(raw))
                head = text[:65_536].splitlines()[:1]
                if head:
                    rows = list(csv.reader(io.StringIO(text), delimiter=max(SEPARATORS, key=head[0].count)))
                    at = {name.strip().lower(): i for i, name in reversed(list(enumerate(rows[0])))}
                    yield pd.DataFrame([[r[at[c]] if c in at and at[c] < len(r) else None for c in columns] for r in rows[1:] if r], columns=columns)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInPandas(read, ", ".join(f"{c} string" for c in columns))


def keyed_objects(df: DataFrame, key: str, text: str, fields: str) -> DataFrame:
    """(key, name, fields) of JSON objects whose values are objects of the fields; what isn't JSON gives no rows."""
    return df.select(key, F.explode(F.from_json(F.col(text), f"map<string, struct<{fields}>>")).alias("name", "x")).select(key, "name", "x.*")


def charset_of(page: Column) -> Column:
    """The charset that a page's bytes declare, utf-8 if none; read as ASCII."""
    said = F.lower(F.regexp_extract(F.decode(page, "ISO-8859-1"), r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1))
    return F.when(said.isin("iso-8859-1", "latin-1", "windows-1252", "cp1252"), "iso-8859-1").otherwise("utf-8")


def decoded_page(page: Column) -> Column:
    return F.when(charset_of(page) == "utf-8", F.decode(page, "UTF-8")).otherwise(F.decode(page, "ISO-8859-1"))


#: Entities that texts hold, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def repaired(x: Column) -> Column:
    """Common entities as characters, line ends as line feeds. Wrongly decoded text is not mended."""
    for said, meant in ENTITIES.items():
        x = F.replace(x, F.lit(said), F.lit(meant))
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _object_in(text: str, name: str) -> tuple[str | None, str | None]:
    """(object, error) of `var name = {...}`: braces are matched outside of quotes."""
    import re

    found = re.search(rf"\bvar\s+{re.escape(name)}\s*=\s*", text)
    if found is None:
        return None, None
    begin = text.find("{", found.end())
    if begin < 0:
        return None, "no brace"
    depth, inside = 0, None
    for m in re.finditer(r"\\.|[\"'{}]", text[begin:], re.S):
        mark = m[0]
        if inside:
            inside = None if mark == inside else inside
        elif mark in "\"'":
            inside = mark
        elif mark in "{}":
            depth += 1 if mark == "{" else -1
            if depth == 0:
                return text[begin : begin + m.end()], None
    return None, "unterminated"


def script_objects(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, object, error) of each row: the object that a script in the text gives a variable, null without one; quotes may hold braces."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *_object_in(html.unescape(x) if x and "&quot;" in x else x or "", name)) for k, x in zip(b[key], b[text], strict=True)], columns=[key, "object", "error"])

    return df.select(key, text).mapInPandas(scan, f"{key} {dict(df.dtypes)[key]}, object string, error string")
