"""Operator 1: byte-level BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read

#: White space as Unicode's White_Space property has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WIDE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same pattern for texts without characters above U+017F; the re module is several times faster.
_L, _N = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
NARROW = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[^\\x00-\\u017f]")
#: A task forgets its distinct pre-tokens beyond so many.
KEPT_WORDS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones
    for themselves, the others by code points from 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizers file of kind byte-level BPE, as arrays that tasks can share."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        byte = byte_alphabet()
        ids, self.special = found["model"]["vocab"], {x["content"]: x["id"] for x in found["added_tokens"]}
        if found["normalizer"] or found["pre_tokenizer"].get("add_prefix_space") or any(x[k] for x in found["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: prefix spaces, normalizers and stripping added tokens are not supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = self.left << 32 | self.right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.first = np.zeros(256, np.int32)
        for char, b in byte.items():
            self.first[b] = ids[char]
        self.bytes = {str(i): bytes(byte[c] for c in piece) for piece, i in ids.items()}
        self.bytes |= {str(i): bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode() for piece, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where they do not merge."""
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[str]:
        """The ids of each pre-token, joined by commas.

        All words lie in one array of symbols. An index maps each mergeable pair to all its positions;
        active ranks are applied in ascending order, each at all its positions at once, and only the
        lists of the pairs next to a merge change.
        """
        if not words:
            return []
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(w) for w in raw])
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[np.concatenate(([0], ends[:-1]))] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.rank_of(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[cut].tolist(), np.split(at, cut[1:]), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        add(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
            to = nxt[at]
            fits = (sym[at] == self.left[r]) & (to >= 0) & (sym[to] == self.right[r])
            at, to = at[fits], to[fits]
            if self.left[r] == self.right[r] and len(at) > 1:  # overlapping places: the leftmost goes first
                free, last = [], -1
                for p, q in zip(at.tolist(), to.tolist(), strict=True):
                    if p != last:
                        free.append(p)
                        last = q
                at = np.array(free)
                to = nxt[at]
            if not len(at):
                continue
            after = nxt[to]
            sym[at], sym[to] = self.made[r], -1
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            add(np.unique(np.concatenate((before[before >= 0], at[after >= 0]))))
        left = np.flatnonzero(sym >= 0)
        text = list(map(str, sym[left].tolist()))
        cuts = np.searchsorted(left, ends).tolist()
        return [",".join(text[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def decode(self, ids: str) -> str:
        """The text of ids joined by commas; special tokens are kept, broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def pre_tokens(text: str) -> list[str]:
    return (WIDE if BEYOND.search(text) else NARROW).findall(text)


class Encoder:
    """Encodes lists of texts; distinct pre-tokens are merged once while it remembers them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[str] = []

    def encode(self, texts: list[str]) -> Iterator[str]:
        """The ids of each text, joined by commas."""
        v = self.vocabulary
        if len(self.number) > KEPT_WORDS:
            self.forget()
        of = self.number.__getitem__
        docs = []
        for text in texts:
            parts: list[np.ndarray | str] = []
            for k, part in enumerate(v.split.split(text) if v.split and any(s in text for s in v.special) else [text]):
                if k % 2:
                    parts.append(str(v.special[part]))
                elif part:
                    parts.append(np.fromiter(map(of, pre_tokens(part)), np.int32))
            docs.append(parts)
        new = list(self.number)[len(self.ids) :]
        self.ids += v.encode_words(new)
        ids = self.ids.__getitem__
        for parts in docs:
            yield ",".join(p if isinstance(p, str) else ",".join(map(ids, p.tolist())) for p in parts)


def encode_documents(docs: DataFrame, vocabulary_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of the decoded text of every row of docs(doc_id, text).

    with_ids: also ids, an array of ints; with_text: also decoded, the text that the ids decode to.
    Null and empty texts have no tokens; repeated rows are each encoded; other columns are ignored.
    No shuffle: each task holds one Arrow batch and a bounded set of distinct pre-tokens.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))  # a fixed vocabulary: a few MB
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())]
    more = [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for begin, end in spans(batch.column(1), 8 << 20):
                part = batch.slice(begin, end - begin)
                rows: list[tuple] = []
                for ids in encoder.encode([x or "" for x in part.column(1).to_pylist()]):
                    text = encoder.vocabulary.decode(ids)
                    raw = text.encode()
                    row = (ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(raw).hexdigest(), len(raw))
                    rows.append((*row, *[list(map(int, ids.split(","))) if ids else []] * with_ids, *[text] * with_text))
                names = [*fields, *more]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True))], names=["doc_id", *(n for n, _ in names)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def spans(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each, one row at least."""
    total, begin = 0, 0
    sizes = pa.compute.binary_length(texts).to_pylist()
    for i, x in enumerate(sizes):
        total += x or 0
        if total >= most:
            yield begin, i + 1
            total, begin = 0, i + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; see encode_documents."""
    return encode_documents(read(spark, sf_dir, "documents"), default_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("n_bytes").alias("decoded_bytes"))
