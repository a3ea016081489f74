"""From raw documents to token ids: quality, exact copies, near copies, mix of sources, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame
that run() writes as Parquet and reads again as the next stage's docs. All but the last return the columns of
documents. Null and empty texts, repeated rows and extra columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from plumbline.llm.bpe import default_vocabulary, encode_documents
from plumbline.llm.common import discard, read, written
from plumbline.llm.exact_dedup import without_copies
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.quality import good_documents
from plumbline.llm.near_texts import without_near_copies
from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels outside the held-out fold."""
    return good_documents(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles similar at 0.8 or more."""
    return without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the text that they decode to."""
    return encode_documents(docs, default_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: A learnt classifier and tokenization are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        discard(before)
        before = docs
    return docs
