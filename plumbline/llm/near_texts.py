"""Operator 7 for whole texts: near copies by word shingles, found through Golay-code fuzzy keys of longer fingerprints and verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, numbered, written
from plumbline.llm.components import components
from plumbline.llm.simhash import golay_index

#: Texts are near copies at this Jaccard similarity of their sets of shingles of so many words: NEAR_PARTS / (NEAR_PARTS + 1).
SHINGLE, NEAR_PARTS = 5, 4
#: Fingerprints for the search are of shorter shingles, of which an edit touches fewer, so that fewer bits differ.
KEY_SHINGLE = 2
#: Near copies whose bits differ at this rate meet in a table with probability RECALL. (At the similarity itself the rate is
#: 0.06 to 0.12 for edits spread over a text and 0.15 at most, where the edits lie together: nine of ten meet even then.)
RATE, RECALL = 0.13, 0.97
#: Bits of the Golay segment, and those by which the first 64 bits of a candidate pair may differ.
GOLAY_BITS, MOST_BITS = 23, 15
#: Two unrelated segments share a key this often, as a power of two; whole bits tell apart what else would meet.
GOLAY_SAYS = 7
#: Tables at least: few rows need few whole bits, and more tables then cost little and find pairs of a higher rate.
LEAST_TABLES = 24
#: Pairs are candidates within a bucket of at most so many rows; a row of a larger one pairs with the closest of its first PIVOTS. A row is held against
#: FIRST partners first, and texts meet in SALTS parts of a partner that very many have.
FEW, PIVOTS, FIRST, SALTS = 32, 6, 3, 16
#: Bits of a set's own fingerprint, in parts of 64, and how many of them sets of that similarity may differ in: their cosine is 8 / 9 at least, so a
#: bit differs at a rate of 0.1515 at most, and three deviations are allowed for. Sets of fewer than SMALL shingles are always compared.
PARTS, MOST_SET_BITS, SMALL = 8, 102, 64
#: Sets that crowded buckets leave apart are compared in tiles of about so many shingles, but so many sets at least; shingles are counted so many at once.
TILE, TILE_SETS, COLUMNS = 1 << 16, 4, 4096
_FLIPS = np.concatenate(([0], 1 << np.arange(GOLAY_BITS))).astype(np.int64)


@cache
def meeting(rate: float) -> float:
    """How often two Golay segments whose bits differ at a rate share a key, over 20,000 pseudorandom pairs."""
    rng = np.random.default_rng(23)
    one = rng.integers(0, 1 << GOLAY_BITS, 20_000)
    two = one ^ (rng.random((len(one), GOLAY_BITS)) < rate) @ (1 << np.arange(GOLAY_BITS))
    a, b = (golay_index(x[:, None] ^ _FLIPS) for x in (one, two))
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


def shape_of_tables(n: int) -> tuple[int, int]:
    """(whole bits of a key, tables) for n texts: a bucket holds about one unrelated text, however many there are."""
    whole = min(31, max(4, math.ceil(math.log2(max(n, 1))) - GOLAY_SAYS))
    met = (1 - RATE) ** whole * meeting(RATE)
    return whole, max(LEAST_TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))


def shingles(text: str, size: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; A-Z in lower case, words parted by ASCII white space. Fewer words give one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash_of(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[:-size] + 1).tolist()]
    return np.array([hash_of(joined[a:b], 42) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray, parts: int) -> np.ndarray:
    """64 * parts bits: each is 1 if it is set in over half of the shingles' hashes, which are mixed anew for each part."""
    count = np.zeros(64 * parts, np.int64)
    odd = np.random.default_rng(7).integers(0, 1 << 63, parts, np.int64).view(np.uint64) | np.uint64(1)
    for k in range(0, len(hashes), 4096):
        x = hashes[k : k + 4096, None] * odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        count += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.int64)
    return 2 * count > len(hashes)


def keyed(docs: DataFrame, whole: int, tables: int) -> DataFrame:
    """(key, row, fp) of docs(row, text): each table's whole bits with each index to which its Golay segment or a neighbour decodes; fp are 64 other bits."""
    width = whole + GOLAY_BITS
    parts = -(-(64 + width * tables) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                bits = np.array([majority_bits(shingles(x.as_py() or "", KEY_SHINGLE), parts) for x in part.column(1)])
                fp = np.packbits(bits[:, :64], axis=1).view(np.int64)[:, 0]
                code = bits[:, 64 : 64 + width * tables].reshape(-1, tables, width)
                front = code[:, :, :whole] @ (1 << np.arange(whole)) + (np.arange(tables) << whole)
                near = np.sort(golay_index((code[:, :, whole:] @ (1 << np.arange(GOLAY_BITS)))[:, :, None] ^ _FLIPS), axis=2)
                new = np.ones(near.shape, bool)
                new[:, :, 1:] = near[:, :, 1:] != near[:, :, :-1]
                at = np.nonzero(new)
                row = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(front[at[0], at[1]] << 12 | near[at]), pa.array(row[at[0]]), pa.array(fp[at[0]])], names=["key", "row", "fp"])

    return docs.select("row", "text").mapInArrow(run, "key long, row long, fp long")


def bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b), a < b, of rows (key, row, fp) sorted by key and row: all of a bucket, or of one of more than FEW rows
    each with the closest of its first PIVOTS. The rows of such buckets are also passed on as (key, a, fp), b null."""
    held = [np.zeros(0, np.int64)] * 3

    def apart(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64))  # of signed numbers it would count the absolute value

    def rows(key: np.ndarray, row: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.nulls(len(row), pa.int64()), pa.array(fp)], names=["key", "a", "b", "fp"])

    def out(key: np.ndarray, row: np.ndarray, fp: np.ndarray, begin: int = 0, large: bool = False) -> Iterator[pa.RecordBatch]:
        """What the buckets from a place on give; large says that they are one bucket of more than FEW."""
        _, at, many = np.unique(key, return_inverse=True, return_counts=True)
        crowded, first = (many[at] > FEW) | large, np.searchsorted(key, key)
        pairs, every = [], np.arange(len(key))
        pivot, least = np.zeros(len(key), np.int64), np.full(len(key), MOST_BITS + 1)
        for p in range(PIVOTS):
            j = every[crowded & (every > first + p) & (every >= begin)]
            bits = apart(fp, first[j] + p, j)
            closer = bits < least[j]
            pivot[j[closer]], least[j[closer]] = first[j[closer]] + p, bits[closer]
        j = np.flatnonzero(least <= MOST_BITS)
        pairs.append(np.stack((row[pivot[j]], row[j])))
        passed = crowded & (every >= begin)
        if passed.any():
            yield rows(key[passed], row[passed], fp[passed])
        key, row, fp = key[~crowded], row[~crowded], fp[~crowded]
        for d in range(1, FEW):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            i = i[apart(fp, i, i + d) <= MOST_BITS]
            pairs.append(np.stack((row[i], row[i + d])))
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        if both.shape[1]:
            none = pa.nulls(both.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(both[0]), pa.array(both[1]), none], names=["key", "a", "b", "fp"])

    given = 0  # rows of the bucket held that have been passed on
    for batch in batches:
        key, row, fp = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        if given and key[0] != held[0][0]:
            held, given = [np.zeros(0, np.int64)] * 3, 0
        held = [np.concatenate(x) for x in zip(held, (key, row, fp), strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:  # the buckets before the last one are whole
            front = [x[:cut] for x in held]
            if given:
                end = int(np.searchsorted(front[0], front[0][0], side="right"))
                yield from out(*(x[:end] for x in front), begin=given, large=True)
                front = [x[end:] for x in front]
            yield from out(*front)
            held, given = [x[cut:] for x in held], 0
        if len(held[0]) > FEW:  # of a crowded bucket that may go on, what tells its pivots is held
            yield from out(*held, begin=given, large=True)
            held, given = [x[:PIVOTS] for x in held], PIVOTS
    if len(held[0]) and not given:
        yield from out(*held)


def marks(sets: DataFrame, side: str) -> list:
    """Columns of sets(row, n, sig) for one side of a pair."""
    return [F.col("row").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"sig{side}")]


def set_bits(a: str = "a", b: str = "b") -> Column:
    """In how many bits the fingerprints of two sets differ."""
    return F.aggregate(F.zip_with(f"sig{a}", f"sig{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def likely(a: str = "a", b: str = "b") -> Column:
    """Whether two sets may be similar enough by their fingerprints and sizes, so that whole sets move for few others."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    return ((2 * NEAR_PARTS + 1) * F.least(na, nb) >= NEAR_PARTS * (na + nb)) & ((F.least(na, nb) < SMALL) | (set_bits(a, b) <= MOST_SET_BITS))


def verified(pairs: DataFrame, sets: DataFrame, salts: int = 1) -> DataFrame:
    """The pairs (a, b) whose sets(row, h) are similar enough, exactly. Each b meets its a in one of so many parts, so that an a may have very many;
    only sets of an a are repeated."""
    h = sets.select("row", "h")
    one = h.select(F.col("row").alias("a"), F.col("h").alias("ha"))
    if salts > 1:
        one = one.join(pairs.select("a").distinct(), "a", "left_semi")
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = pairs.select("a", "b").join(h.select(F.col("row").alias("b"), F.col("h").alias("hb")), "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts))).join(one, ["a", "salt"])
    same = F.size(F.array_intersect("ha", "hb"))
    return met.where((2 * NEAR_PARTS + 1) * same >= NEAR_PARTS * (F.size("ha") + F.size("hb"))).select("a", "b")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(row, n, h, sig) of docs(row, text): the distinct shingles' number, hashes and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                found = [np.unique(shingles(x.as_py() or "", SHINGLE)) for x in part.column(1)]
                sizes = np.array([len(x) for x in found], np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                sig = np.concatenate([np.packbits(majority_bits(x, PARTS)) for x in found]).view(np.int64)
                lists = [pa.LargeListArray.from_arrays(pa.array(e, pa.int64()), pa.array(v)).cast(pa.list_(pa.int64())) for e, v in ((ends, np.concatenate(found).view(np.int64)), (np.arange(len(found) + 1) * PARTS, sig))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *lists], names=["row", "n", "h", "sig"])

    return docs.select("row", "text").mapInArrow(run, "row long, n long, h array<long>, sig array<long>")


def tile_links(table: pa.Table) -> pa.Table:
    """Links (a, b) among the sets (row, component, h) of a table, as many as join what all its pairs that are similar enough join, exactly."""
    table = table.combine_chunks()
    row, of = table["row"].to_numpy(), table["component"].to_numpy()
    lists = table["h"].chunk(0)
    n = np.diff(lists.offsets.to_numpy())
    _, token, many = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(row)), n), many[token] > 1
    owner, token = owner[shared], (np.cumsum(many > 1) - 1)[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    same = np.zeros((len(row), len(row)), np.int64)
    for begin in range(0, int((many > 1).sum()), COLUMNS):
        i, j = np.searchsorted(token, (begin, begin + COLUMNS))
        has = np.zeros((len(row), COLUMNS), np.float32)
        has[owner[i:j], token[i:j] - begin] = 1
        same += (has @ has.T).astype(np.int64)
    joined = ((2 * NEAR_PARTS + 1) * same >= NEAR_PARTS * (n[:, None] + n)) | (of[:, None] == of)
    left, a, b = np.ones(len(row), bool), [], []
    while left.any():  # a tree from the first row left
        front = np.array([left.argmax()])
        while len(front):
            left[front] = False
            after = np.flatnonzero(joined[front].any(0) & left)
            before = front[joined[np.ix_(front, after)].argmax(0)]
            new = of[before] != of[after]
            a.append(np.minimum(row[before], row[after])[new])
            b.append(np.maximum(row[before], row[after])[new])
            front = after
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components of members(main, row, component, n): the rows of a main that are outside that component are compared with
    all others of it, exactly. Rows are dealt out to tiles, and each pair of tiles is one group: a row moves once for each tile of its main that it
    is compared with and not once for each pair."""
    out = F.col("component") != F.col("main")
    tiles = lambda of: F.greatest(F.lit(1), F.ceil(F.least(F.sum(F.when(of, F.col("n"))) / TILE, F.count(F.when(of, 1)) / TILE_SETS))).cast("long")
    dealt = members.join(members.groupBy("main").agg(tiles(~out).alias("inner"), tiles(out).alias("outer")), "main")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("row"), F.when(out, F.col("outer")).otherwise(F.col("inner"))))
    # tiles of the main component count from -1 downwards
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    others = F.concat(F.transform(upto("outer"), lambda t: cell(F.least("tile", t), F.greatest("tile", t))), F.transform(upto("inner"), lambda t: cell(F.col("tile"), -1 - t)))
    cells = F.when(out, others).otherwise(F.transform(upto("outer"), lambda t: cell(t, -1 - F.col("tile"))))
    met = dealt.select("main", "row", "component", F.explode(cells).alias("cell")).join(sets.select("row", "h"), "row")
    return met.groupBy("main", "cell").applyInArrow(tile_links, "a long, b long")


def near_links(docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between rows of docs(row, text), row being unique; they join the same components as all candidate pairs that are near copies.

    Pairs of a bucket are candidates if the first 64 bits of their fingerprints are close. Each row is held against its first partners; after
    that only pairs between different components are: the other candidates, as far as the fingerprints of their sets allow, and in crowded buckets,
    which copies of one text fill, the rows outside the largest component with all others, in tiles. Two components that other candidates share are first
    compared by their closest pair, and by the others only if they are still apart. So a group of copies costs its rows and not its pairs, and
    look-alikes that are no copies cost no row for each pair.
    """
    whole, tables = shape_of_tables(docs.count())
    met = written(keyed(docs, whole, tables).repartition("key").sortWithinPartitions("key", "row").mapInArrow(bucket_pairs, "key long, a long, b long, fp long"))
    crowded = met.where("b IS NULL").select("key", F.col("a").alias("row"))
    pairs = written(met.where("b IS NOT NULL").select("a", "b").distinct())
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).union(crowded.select("row")).distinct())  # so that Spark knows its size, and texts mostly stay where they are
    sets = written(shingle_sets(docs.join(nodes, "row", "left_semi")))
    discard(nodes)
    first = _first_partners(pairs)
    chosen = written(first.join(sets.select(*marks(sets, "b")), "b").join(sets.select(*marks(sets, "a")), "a").where(likely()).select("a", "b"))
    links = written(verified(chosen, sets, SALTS))
    discard(chosen)
    # of the other candidates only those between components
    of = components(links).select(F.col("node").alias("row"), "component")
    marked = written(sets.select("row", "n", "sig").join(of, "row", "left").withColumn("component", F.coalesce("component", "row")))
    placed = written(crowded.join(marked.select("row", "component", "n"), "row"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", (-F.col("component")).alias("less"))).alias("most"), F.count("*").alias("parts"))
    split = parts.where("parts > 1").select("key", (-F.col("most.less")).alias("main"))
    tiled = written(compared(placed.join(split, "key").select("main", "row", "component", "n").distinct(), sets))
    side = lambda c: marked.select(*marks(marked, c), F.col("component").alias(f"of_{c}"))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(side("b"), "b").join(side("a"), "a").where((F.col("of_a") != F.col("of_b")) & likely())
    rest = written(apart.select("a", "b", F.least("of_a", "of_b").alias("low"), F.greatest("of_a", "of_b").alias("high"), set_bits().alias("bits")))
    discard(met, pairs, first, placed)
    # the closest pair of two components settles them, mostly; only where it didn't, their other pairs are compared
    best = written(rest.groupBy("low", "high").agg(F.min(F.struct("bits", "a", "b")).alias("best")).select("best.a", "best.b"))
    settled = written(verified(best, sets, SALTS).union(tiled))
    discard(tiled)
    joined = written(components(settled.join(marked.select(F.col("row").alias("a"), F.col("component").alias("of_a")), "a").join(marked.select(F.col("row").alias("b"), F.col("component").alias("of_b")), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    now = lambda df, c: df.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"now_{c}")), c, "left").withColumn(f"now_{c}", F.coalesce(f"now_{c}", c))
    last = written(now(now(rest.join(best, ["a", "b"], "left_anti"), "low"), "high").where("now_low <> now_high").select("a", "b"))
    discard(rest, best, marked, joined)
    final = written(verified(last, sets, SALTS))
    discard(last, sets)
    return links.union(settled).union(final)


def _first_partners(pairs: DataFrame) -> DataFrame:
    """The FIRST smallest a of each b; a b has at most its keys times FEW."""
    few = pairs.groupBy("b").agg(F.slice(F.array_sort(F.collect_list("a")), 1, FIRST).alias("first"))
    return written(few.select(F.explode("first").alias("a"), "b"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of docs(doc_id, text, ...), that of the smallest doc_id (null last, then the first row), with its columns.

    Groups are the components of texts whose sets of five-word shingles are similar at 0.8 or more, found with the recall that the constants
    state. Null and empty texts are alike; a text of fewer words is one shingle; repeated rows are near copies; an empty table gives an empty one.
    """
    table, row = numbered(docs)
    links = near_links(table.select(F.col(row).alias("row"), "text"))
    of = components(links).select(F.col("node").alias(row), "component")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    members = table.select(row, "doc_id").join(of, row)
    stays = members.groupBy("component").agg(best.alias("best")).select(F.col(f"best.{row}").alias(row))
    dropped = written(of.select(row).join(stays, row, "left_anti"))
    return table.join(dropped, row, "left_anti").select(*docs.columns)
