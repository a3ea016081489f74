"""Operator 9: secret scans by patterns and dictionary-primed zstandard novelty."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import read

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Words that make a place sensitive, lower case.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private_key", "access_key", "auth", "bearer")
CONTEXT = re.compile("|".join(SENSITIVE), re.I | re.A)
#: A candidate: a run of these characters, of LEAST or more, that begins within NEAR characters behind a sensitive word.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST, NEAR = 16, 48
#: Characters on each side that prime the compressor, beside the identifiers.
AROUND = 1024
#: A candidate is news from this share of a byte per character, or of the bytes of the cheapest of ORDERS copies in random order, which nothing foretells.
NOVELTY, ORDERS = 0.8, 8
#: It must also hold so much of what its kinds of characters can say (so that runs are none), and so many bytes.
EVEN, LEAST_BYTES = 0.9, NOVELTY * LEAST
#: Names and values that code repeats; they prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey credential private_key access_key authorization bearer username config settings default "
    "example placeholder changeme undefined environment variable function return import export public static string integer boolean "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX "
    "https://www.example.com/ http://localhost:8080/ database connection session client server request response header content"
)
_HEX_LETTERS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LONG_HEX = b"x" * LEAST_HEX


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and not overlapping within a kind; matches too short are dropped.

    A cheap test for what every match contains comes first: most texts have none.
    """
    found, low = [], text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _LONG_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_LETTERS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Compressed bytes that the candidate adds, with identifiers and the text around it as the dictionary."""
    primer = zstandard.ZstdCompressionDict(f"{IDENTIFIERS}\n{after}\n{before}".encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_dict_id=False).compress
    tail = before[-16:]
    return len(compress((tail + candidate).encode("utf-8", "surrogatepass"))) - len(compress(tail.encode("utf-8", "surrogatepass")))


def is_news(candidate: str, before: str, after: str) -> bool:
    """Whether the candidate costs about what its characters cost in random order, at any length.

    Long strings of few kinds of characters cost less than a byte each, however random: 0.5 in hex, 0.75 in base64.
    """
    n, cost = len(candidate), marginal_bytes(candidate, before, after)
    if cost >= NOVELTY * n:
        return True
    if cost < max(LEAST_BYTES, EVEN * n * log2(len(set(candidate))) / 8):
        return False
    rng = random.Random(n)
    return cost >= NOVELTY * min(marginal_bytes("".join(rng.sample(candidate, n)), before, after) for _ in range(ORDERS))


def runs_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, mixed until) of the text's runs of a candidate's characters; what begins before the last holds a letter and a digit: words are no candidates."""
    found = []
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() >= LEAST:
            start, run = m.start(), m[0]
            letter = len(run.rstrip("0123456789+/_=-"))
            digit = len(run.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"))
            found.append((start, m.end(), start + min(letter, digit)))
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strings in sensitive places that neither their surroundings nor the identifiers foretell.

    A run of a candidate's characters is judged once: from its start, if a sensitive word ends up to NEAR characters before it, or from the
    end of the first sensitive word in it. A string that a base span overlaps is not reported again. Sensitive words and
    runs are walked side by side and base spans are bisected, so time is in proportion to the text.
    """
    ends = [m.end() for m in CONTEXT.finditer(text)]
    if not ends:
        return []
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    found, k = [], 0
    for begin, end, mixed in runs_of(text):
        while k < len(ends) and ends[k] + NEAR < begin:
            k += 1
        if k == len(ends):
            break
        start = max(begin, ends[k])
        before = bisect_left(starts, end)
        if end - start < LEAST or start >= mixed or (before and reach[before - 1] > start):
            continue
        if is_news(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]):
            found.append((start, 3, end))
    return found


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, as (start, kind, end), in order."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans of every row of docs(doc_id, text).

    Spans are in code points, end exclusive, ordered by start, then kind. Null texts count as empty and
    have no spans. Repeated rows are scanned alike; other columns are ignored; an empty table gives an empty one. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_assign", "n_access", "n_hex", "n_novel"]
        for batch in batches:
            found = [scan(x.as_py() or "") for x in batch.column(1)]
            counts = [pa.array([sum(s[1] == k for s in every) for _, every in found], pa.int64()) for k in range(4)]
            digests = pa.array([sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(every) for _, every in found], pa.string())], names=["doc_id", *names, "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets; see secret_spans."""
    return secret_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
