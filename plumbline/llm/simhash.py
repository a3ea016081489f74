"""Operator 7: SimHash near-deduplication through Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read, written
from plumbline.llm.components import components

BITS = 64
#: Fingerprints link at so many differing bits at most. The keys below are exact for two.
MOST_BITS = 2
SHINGLE = 3
#: (lowest bit, width) of the segments: three, so that two errors leave one of them whole.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: Pairs of a bucket of at most so many are compared one by one; larger ones link through shared neighbour words.
FEW = 8
#: A bucket beyond so many fingerprints is not held in one task; its rows link in a grouped job.
HELD = 20_000


def fingerprint(text: str) -> int:
    """The 64 majority bits of the XXH64 values (seed 42) of the text's word shingles."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return hash_of(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    counts, n = np.zeros(BITS, np.int64), len(words) - SHINGLE + 1
    first, last = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    for k in range(0, n, 65_536):
        h = np.array([hash_of(joined[a:b], 42) for a, b in zip(first[k : k + 65_536], last[k : k + 65_536], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(key, text) as key, fp: the fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py() or "") for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(run, f"key {kind}, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by the generator of the upper 12 bits, and the error pattern of each remainder.

    The code is perfect: the patterns of at most three errors have all 2**11 remainders, one each.
    """

    def remainder(x: int) -> int:
        while x.bit_length() > 11:
            x ^= GOLAY << (x.bit_length() - 12)
        return x

    upper = np.array([remainder(x << 11) for x in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            errors[remainder(pattern)] = pattern
    return upper, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """The index (upper 12 bits) of the codeword nearest to each 23-bit word."""
    upper, errors = golay_tables()
    return (words ^ errors[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys of which two fingerprints that differ in two bits at most share one at least.

    Two errors leave one of three segments whole (pigeonhole), and the next segment has two at most.
    Words that differ in two bits share a neighbour, so the indices of the codewords to which a segment
    and its 23 neighbours decode have one in common. A key is the whole segment with one such index.
    """
    parts = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.int64)
    rows, keys = [], []
    for i in range(len(parts)):
        near = np.sort(golay_index(parts[(i + 1) % len(parts)][:, None] ^ flips), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(new)
        rows.append(row)
        keys.append(i << 40 | parts[i][row] << 12 | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def neighbour_words(fp: np.ndarray) -> np.ndarray:
    """Each fingerprint and the 64 words at one bit from it; two differ in two bits at most if and only if they share one."""
    return fp[:, None] ^ np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64))).view(np.int64)


def links_of_bucket(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the same components as all pairs of fp that differ in two bits at most; distinct fp."""
    if len(fp) <= FEW:
        i, j = np.triu_indices(len(fp), 1)
        close = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= MOST_BITS  # of signed numbers it would count the absolute value
        return fp[i[close]], fp[j[close]]
    _, word = np.unique(neighbour_words(fp), return_inverse=True)
    word = word.reshape(len(fp), -1)
    label = np.arange(len(fp))
    while True:
        least = np.full(word.max() + 1, len(fp))
        np.minimum.at(least, word, label[:, None])
        now = least[word].min(1)
        now = np.minimum(now, now[now])
        if (now == label).all():
            return fp, fp[label]
        label = now


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each bucket of rows (key, fp) sorted by both; a row of a bucket beyond HELD is passed on with hot set."""
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    held, held_key, flooded = [], None, False

    def give() -> pa.RecordBatch:
        a = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.int64)
        hot = np.repeat([x[2] for x in out], [len(x[0]) for x in out]) if out else np.zeros(0, bool)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(hot.astype(bool))], names=["a", "b", "hot"])

    def close() -> None:
        nonlocal held, flooded
        fp = np.concatenate(held) if held else np.zeros(0, np.int64)
        if len(fp) > 1:
            out.append((*links_of_bucket(fp), False))
        held, flooded = [], False

    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            if key[begin] != held_key:
                close()
                held_key = key[begin]
            held.append(fp[begin:end].copy())
            if flooded or sum(map(len, held)) > HELD:
                flooded = True
                out += [(x, x, True) for x in held]
                held = []
        if out:
            yield give()
    close()
    if out:
        yield give()


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the fp of distinct(fp) with the components of all pairs at two differing bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, key = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(run, "key long, fp long")
    met = written(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(bucket_links, "a long, b long, hot boolean").where("hot or a <> b").distinct())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k in range(0, len(fp), 1000):
                words = neighbour_words(fp[k : k + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(words.ravel()), pa.array(np.repeat(fp[k : k + 1000], words.shape[1]))], names=["word", "fp"])

    crowded = met.where("hot").select(F.col("a").alias("fp")).distinct().mapInArrow(spread, "word long, fp long")
    least = crowded.groupBy("word").agg(F.min("fp").alias("b"))
    rest = crowded.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return met.where("not hot").select("a", "b").union(rest)


def grouped(marked: DataFrame) -> DataFrame:
    """(fp, component) of the distinct fingerprints of marked(fp); component is the smallest fingerprint reachable."""
    nodes = marked.select("fp").distinct()
    found = components(near_links(nodes)).withColumnRenamed("node", "fp")
    return written(nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of each row of docs(doc_id, text).

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id reachable, null only
    where no row reached has one. Null and empty texts have fingerprint zero and link like any other; repeated
    rows are rows of their own; other columns are ignored. Equal fingerprints are one node, so copies cost a
    map-side minimum; a bucket yields one link per fingerprint, not its pairs.
    """
    marked = written(fingerprints(docs.select(F.col("doc_id").alias("key"), "text")).withColumnRenamed("key", "doc_id"))
    of = grouped(marked)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    name = least.join(of, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(of.join(name, "component"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component; see simhash_groups."""
    return simhash_groups(read(spark, sf_dir, "documents"))
