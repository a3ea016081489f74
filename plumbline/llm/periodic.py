"""Operator 11: periodic runs of words, by seeds and extension along diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts are searched together up to so many bytes.
TOGETHER = 1 << 20


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(k, first lag, last lag) of classes of lags up to the longest: what a run of such a lag is sure to hold, and what makes its seeds few.

    A run of period q repeats max(LEAST_WORDS, 3 q) - q words at lag q: at least 16, and at least 2 q. So each run has a k-gram that
    occurs again q words on if k is 16 (q up to 10), or if k is at most 2 q. If k is at least 3 q / 2 too, there is no other occurrence of that k-gram
    between the two: one at distance d < q would give the k words both periods q and d, and the same at q - d; but two periods that
    add up to no more than k words have a common divisor as a period, and the run's period would not be its smallest. One of d and q - d is
    at most q / 2, and q / 2 + q <= k. So neighbouring occurrences of the k-grams give every run, and no group of k copies needs its k^2 pairs.
    """
    k, low = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS, 1
    while low <= longest:
        high = 2 * k // 3
        yield k, low, min(high, longest)
        low = high + 1
        k = 2 * low


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of (a, b, position), and where a new pair (a, b) begins. Numbers are not negative."""
    n, base = len(a), int(max(a.max(initial=0), b.max(initial=0))) + 1
    if base * base * n < 1 << 62:
        both = (a * base + b) * n + np.arange(n)
        both.sort()
        order = both % n
    else:
        order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(n, bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, new


def _shifted(names: np.ndarray, by: int) -> np.ndarray:
    """names so many places on; 0 beyond the end, where names that reach over the last part are unique already."""
    out = np.zeros(len(names), np.int64)
    out[: max(len(names) - by, 0)] = names[by:]
    return out


def _reach(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """The last place from at on, in steps of 1 or -1, up to which w repeats at a lag."""
    size, limit = 64, len(w) - lag - 1 if step > 0 else 0
    while at != limit:
        n = min(size, abs(limit - at))
        i = slice(at + 1, at + 1 + n) if step > 0 else slice(at - n, at)
        same = w[i] == w[i.start + lag : i.stop + lag]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return at + step * int(np.argmin(same))
        at, size = at + step * n, 2 * size
    return at


def find_runs(w: np.ndarray, text: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) rows of every run of w, word numbers in which a unique one ends each text; periods up to the longest, text says whose a place is.

    A run is a stretch of smallest period q that no neighbour extends, of LEAST_WORDS words and LEAST_PERIODS periods at least. Names of
    m-grams are exact (pairs of names of halves, sorted). A text in which no k-gram occurs twice leaves the search. Seeds of a
    lag are taken from left to right, and one in what the lag has covered already is not extended again.
    """
    found, names, at, m = [], w, np.arange(len(w)), 1
    for k, low, high in lag_classes(longest):
        while 2 * m <= k:
            order, new = _ordered(names, _shifted(names, m))
            names = np.empty(len(names), np.int64)
            names[order] = np.cumsum(new) - 1
            m *= 2
        order, new = _ordered(names, _shifted(names, k - m))
        again = np.flatnonzero(~new[1:])
        first, lags = order[again], order[again + 1] - order[again]
        of_class = (lags >= low) & (lags <= high)
        first, lags = at[first[of_class]], lags[of_class]
        by_lag = np.lexsort((first, lags))
        first, lags = first[by_lag], lags[by_lag]
        head = np.ones(len(first), bool)
        head[1:] = (lags[1:] != lags[:-1]) | (first[1:] != first[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(first[head].tolist(), lags[head].tolist(), strict=True):
            if i <= covered.get(q, -1):
                continue
            begin, end = _reach(w, i, q, -1), _reach(w, i, q, 1)
            covered[q] = end
            if (length := end - begin + 1 + q) >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((begin, length, q))
        stays = np.zeros(len(w), bool)
        stays[text[at[order[again]]]] = True
        if not len(again):
            break
        if len(names) > 2 * (keep := stays[text[at]]).sum():
            names, at = names[keep], at[keep]
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, how many each text has): words are parted by ASCII white space; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
    real = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), np.diff(kept[np.concatenate(([0], np.cumsum(ends)))])


def search(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(number of words, runs, collapsed text) of each text."""
    flat, n = words_of(texts)
    ends = np.cumsum(n)
    codes = flat.dictionary_encode()
    every = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(n)), n + 1)  # each text's words, then one that is unique
    w = np.empty(len(text), np.int64)
    mark = ends + np.arange(len(n))
    w[mark] = len(codes.dictionary) + np.arange(len(n))
    w[np.setdiff1d(np.arange(len(w)), mark, assume_unique=True)] = every
    runs = find_runs(w, text, int(n.max(initial=0)) // LEAST_PERIODS)
    of = text[runs[:, 0]]
    runs[:, 0] -= of  # places among words alone
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change)[:-1] == 0
    left = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], ends))]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(keep))), " ")
    fields = pa.StructArray.from_arrays([pa.array(c) for c in (runs[:, 0] - (ends - n)[of], runs[:, 1], runs[:, 2])], names=["start", "length", "period"])
    return n, pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32()), fields), collapsed


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and the collapsed text of each row of docs(doc_id, text).

    Words are parted by ASCII white space and compared exactly. The collapsed text has the words, joined by one space, that are in no run or in
    the first period of each run that they are in. Null and empty texts have no words, no runs and an empty collapsed
    text; repeated rows are treated alike; other columns are ignored. A text is searched in memory linear in its length and in time
    n log^2 n; short texts are searched together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(size) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    n, runs, collapsed = search(batch.column(1).slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs(doc_id, text), in which every tenth document by crc32 of its id repeats a stretch of its words to its end.

    h is the checksum of the decimal doc_id and g = floor(h / 10). If h % 10 = 0 and the text has n > 0 words, each word i >= a is word a + (i - a) % p of
    the text, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    d = d.select("*", F.size("words").cast("long").alias("n"))
    d = d.select("*", F.when(F.col("n") > 0, F.expr("g % n")).alias("a"))
    d = d.select("*", F.expr("CASE WHEN n > 0 THEN 1 + (n - a) div (3 + g % 8) END").alias("p"))
    cut = lambda begin, n: F.slice("words", (begin + 1).cast("int"), n.cast("int"))
    a, p, tail = F.col("a"), F.col("p"), F.col("n") - F.col("a")
    repeated = F.concat(cut(F.lit(0), a), F.flatten(F.array_repeat(cut(a, p), F.expr("(n - a) div p").cast("int"))), cut(a, tail % p))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def _before(x: Column, y: Column) -> Column:
    """Whether run x has the greater exponent than y, exactly, or comes before it."""
    left, right = x["length"] * y["period"], y["length"] * x["period"]
    return (left > right) | ((left == right) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, the one of the greatest exponent, and digests; see planted and periodic_runs."""
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    first = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | _before(r, best), r).otherwise(best))
    found = found.withColumn("best", first)
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(said).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
