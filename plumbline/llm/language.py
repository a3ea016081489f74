"""Operator 10: language identification by cross-parsing entropy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import spans
from plumbline.llm.common import held_out, read

#: Learnt from at most so many labelled documents of a language, whole texts, whose lengths add up to so many characters.
LEARN_DOCS, LEARN_CHARS = 40, 40_000
#: Bits of a symbol: code points have 21. An odd number spreads keys over a hash table.
SYMBOL, ODD = 21, 0x9E3779B97F4A7C15
#: Symbols of a piece, those for which all pieces go on beyond their ends together, and bytes of text that a task parses at once; none changes a result.
PIECE, BEYOND, TOGETHER = 256, 48, 2 << 20
#: Symbols times languages that are held at once (one language at least).
CELLS = 1 << 24
SHARPNESS = 8.0


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by symbol of each state of the automaton of all substrings of codes; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class Transitions:
    """A hash table of (state, symbol) to state for whole arrays: as large as the transitions, whatever the alphabet."""

    def __init__(self, keys: np.ndarray, states: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.states = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, todo = self.first(keys), np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            mine = self.keys[slot] == keys[todo]
            self.states[slot[mine]] = states[todo[mine]]
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & self.mask
        self.seen = memoryview(self.keys)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(ODD)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The state behind each key, -1 where there is none."""
        at = self.first(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.states[at], -1).astype(np.int64)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.states[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def one(self, key: int) -> int:
        """find for one key."""
        keys, at = self.seen, (key * ODD & (1 << 64) - 1) >> int(self.shift)
        while (there := keys[at]) != key:
            if there < 0:
                return -1
            at = at + 1 & self.mask
        return int(self.states[at])


class CrossParser:
    """One suffix automaton per language over its labelled text.

    A text is cut, from left to right, into the longest matches with a language's labelled text; a character that
    it doesn't hold is a phrase of its own. A phrase costs the logarithm of the labelled text's length, so the
    cost per character estimates the cross entropy. The language of the fewest bits wins, the first by name if equal.
    Symbols are the code points of lower-case letters; a run of anything else is symbol 0.
    """

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.langs = sorted(lang for lang, _ in texts)
        keys, states, starts, bits, base = [], [], [], [], 0
        for _, text in sorted(texts):
            codes = self.codes(text).tolist()
            step = suffix_automaton(codes)
            many = np.fromiter(map(len, step), np.int64, len(step))
            symbols = np.fromiter((c for to in step for c in to), np.int64, int(many.sum()))
            states.append(np.fromiter((t for to in step for t in to.values()), np.int64, len(symbols)) + base)
            keys.append((np.repeat(np.arange(len(step)), many) + base) << SYMBOL | symbols)
            starts.append(base)
            bits.append(math.log2(len(codes) + 2))
            base += len(step)
        none = [np.zeros(0, np.int64)]
        self.table = Transitions(np.concatenate(keys + none), np.concatenate(states + none))
        self.starts, self.bits = np.array(starts, np.int64), np.array(bits)

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """Symbols of a text; runs of what is not a letter become one."""
        codes = code_points(text)
        codes = np.where(letters()[codes], codes, 0)
        if len(codes):
            keep = codes != 0
            keep[1:] |= codes[:-1] != 0
            codes = codes[keep]
        return codes

    def advance(self, state: np.ndarray, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind a symbol each, and whether a phrase begins with it: one ends where its match can't go on; a symbol that the labelled text lacks is one by itself."""
        to = self.table.find(state << SYMBOL | symbol)
        begins = (state == start) | (to < 0)
        at = np.flatnonzero(to < 0)
        again = self.table.find(start[at] << SYMBOL | symbol[at])
        to[at] = np.where(again < 0, start[at], again)
        return to, begins

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text with each language, so many languages at a time that what is held is in proportion to the texts alone."""
        some = max(1, CELLS // max(1, sum(map(len, coded))))
        return np.concatenate([np.zeros((len(coded), 0), np.int64), *(self.parsed(coded, self.starts[k : k + some]) for k in range(0, len(self.starts), some))], axis=1)

    def parsed(self, coded: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Phrases of each text with each of some languages, given by the first states of their automata.

        Texts are cut into pieces that are parsed side by side, each as if a phrase began with it. A piece's parse then goes on beyond its
        end until one of its phrases begins where one does in the parse of the piece it has come to: from there both are the
        same. So the parse of the whole text is followed from its first piece, as if it had not been cut. Where that takes more than BEYOND
        symbols, as in text that repeats itself, the one parse that is followed goes on alone.
        """
        sizes = np.array([len(c) for c in coded], np.int64)
        flat = np.concatenate([*coded, np.zeros(0, np.int64)]).astype(np.int64)
        ends = np.cumsum(sizes)
        pieces = -(-sizes // PIECE)
        first = np.cumsum(pieces) - pieces
        text = np.repeat(np.arange(len(coded)), pieces)
        begin = (ends - sizes)[text] + (np.arange(len(text)) - first[text]) * PIECE
        end = np.minimum(begin + PIECE, ends[text])
        width = len(starts)
        start = np.repeat(starts, len(text))  # languages one after the other, their pieces within
        state, told = start.copy(), np.zeros((width, len(flat) + 1), bool)
        for j in range(PIECE):
            open_ = np.flatnonzero(begin + j < end)
            if not len(open_):
                break
            at = open_ if len(open_) < len(text) else slice(None)
            place = begin[at] + j
            now = state.reshape(width, -1)[:, at].ravel()
            to, begins = self.advance(now, np.tile(flat[place], width), np.repeat(starts, len(place)))
            state.reshape(width, -1)[:, at] = to.reshape(width, -1)
            told[:, place] = begins.reshape(width, -1)
        # beyond the ends
        lang, piece = np.divmod(np.arange(width * len(text)), max(1, len(text)))
        over, place = np.zeros(len(lang), np.int64), end[piece]
        open_ = (end < ends[text])[piece]
        row = np.flatnonzero(open_)
        for _ in range(BEYOND):
            to, begins = self.advance(state[row], flat[place[row]], start[row])
            met = begins & told[lang[row], place[row]]
            state[row] = np.where(met, state[row], to)
            over[row] += begins & ~met
            place[row] += ~met
            row_done = met | (place[row] == ends[text[piece[row]]])
            open_[row[row_done]] = False
            row = row[~row_done]
            if not len(row):
                break
        # from the first piece of each text on
        before = np.zeros((width, len(flat) + 1), np.int32)
        np.cumsum(told[:, :-1], axis=1, out=before[:, 1:])
        found = np.zeros((width, len(coded)), np.int64)
        lang, doc = (x.ravel() for x in np.indices(found.shape))
        at = (ends - sizes)[doc]
        symbols, begun = memoryview(flat), [memoryview(x) for x in told]
        while True:
            on = np.flatnonzero(at < ends[doc])
            if not len(on):
                return found.T
            k, d = lang[on], doc[on]
            q = first[d] + (at[on] - (ends - sizes)[d]) // PIECE
            r = k * len(text) + q
            found[k, d] += before[k, end[q]] - before[k, at[on]] + over[r]
            at[on] = place[r]
            for i in np.flatnonzero(open_[r]).tolist():
                more, at[on[i]] = self.alone(int(state[r[i]]), symbols, int(place[r[i]]), int(ends[d[i]]), int(starts[k[i]]), begun[k[i]])
                found[k[i], d[i]] += more

    def alone(self, state: int, symbols: memoryview, place: int, end: int, start: int, told: memoryview) -> tuple[int, int]:
        """(phrases that begin, place reached) of a parse from a place until one of its phrases begins where told says, or the text ends."""
        one, found = self.table.one, 0
        for i in range(place, end):
            c = symbols[i]
            to = one(state << SYMBOL | c)
            if state == start or to < 0:
                if told[i]:
                    return found, i
                found += 1
                if to < 0:
                    to = one(start << SYMBOL | c)
            state = start if to < 0 else to
        return found, end

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs or not texts:
            return [("und", 0.0)] * len(texts)
        coded = [self.codes(t) for t in texts]
        cost = self.phrases(coded) * self.bits / np.array([max(1, len(c)) for c in coded])[:, None]
        best = cost.argmin(1)
        share = np.exp2(-SHARPNESS * (cost - cost.min(1, keepdims=True)))
        score = share[np.arange(len(texts)), best] / share.sum(1)
        return [(self.langs[b], float(s)) if c.any() else ("und", 0.0) for b, s, c in zip(best, score, coded, strict=True)]


@cache
def parser_of(texts: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(texts)


def labelled_text(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(lang, text) pairs: a sample of whole texts of each language outside the held-out fold, in the order of a hash of the id.

    At most LEARN_DOCS documents of a language; one with which their lengths would pass LEARN_CHARS is passed over, and where none is short enough
    the shortest is taken. Ids are ranked after a threshold on the hash that leaves about two times as many, so that no task ranks all of
    a language. Of several texts of an id the first by code point counts.
    """
    fold = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    # a row a language, each of which the model holds an automaton of
    rates = fold.groupBy("lang").agg(((2 * LEARN_DOCS + 40) / F.count("*")).alias("rate"))
    near = fold.join(F.broadcast(rates), "lang").where(place < F.col("rate")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id")
    ranked = near.withColumn("nth", F.row_number().over(order)).where(f"nth <= {LEARN_DOCS}")
    # numbers alone reach the driver first: LEARN_DOCS a language, then the chosen texts
    rows = ranked.select("lang", "doc_id", "nth", F.length("text").alias("n")).orderBy("lang", "nth").collect()
    chosen = []
    for _, part in groupby(rows, key=lambda r: r.lang):
        part, total, kept = list(part), 0, []
        for r in part:
            if total + r.n <= LEARN_CHARS:
                kept.append(r)
                total += r.n
        chosen += kept or [min(part, key=lambda r: (r.n, r.nth))]
    spark = docs.sparkSession
    asked = spark.createDataFrame([(r.lang, r.doc_id, r.nth) for r in chosen], f"lang string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, nth int")
    texts = near.join(F.broadcast(asked), ["lang", "doc_id"]).select("lang", "nth", "text").collect()
    texts = sorted(texts, key=lambda r: (r.lang, r.nth))
    return tuple((lang, "\n".join(r.text for r in part)) for lang, part in groupby(texts, key=lambda r: r.lang))


def languages(docs: DataFrame, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text).

    lang_pred is `und` with score 0 for null texts, texts without a letter, and if nothing was learnt. Repeated
    rows are predicted alike; other columns are ignored; an empty table gives an empty one. No shuffle; whole texts are parsed,
    and time and memory are in proportion to their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # LEARN_CHARS characters a language, or one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(shared.value)
        for batch in batches:
            for begin, end in spans(batch.column(1), TOGETHER):
                part = batch.slice(begin, end - begin)
                found = parser.predict([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; learnt outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return languages(docs, labelled_text(docs))
