"""Operator 3: toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, learning_rows, read, sample_to_driver

WORD = re.compile(r"[^\W\d_]+")
#: Hashed terms, and the length of the word beginnings that are terms too.
SPACE = 1 << 20
STEM = 5
#: At most so many labelled documents are learnt from, half of each label where there are enough.
LEARN_ROWS = 8_000
#: Terms of so many documents have parameters, whatever their effect.
LEAST_DOCS = 3
#: Squared gradients that each parameter starts with, so that a rare term moves little.
HELD_BACK = 3.0
FACTORS, EPOCHS, RATE, DECAY, SEED = 8, 40, 0.1, 1e-5, 7
#: A document whose probability errs by less changes nothing, so that hard ones count.
SETTLED = 0.02
THRESHOLD = 0.7
#: A task forgets its distinct words beyond so many.
KEPT_WORDS = 300_000


def terms_of_word(word: str) -> list[int]:
    """The hashed terms of a lower-case word: itself and its beginning."""
    raw = word.encode("utf-8", "surrogatepass")
    return [crc32(raw) % SPACE] + ([crc32(b"^" + word[:STEM].encode("utf-8", "surrogatepass")) % SPACE] if len(word) > STEM else [])


def terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a text."""
    return np.unique(np.array([t for w in set(WORD.findall(text.lower())) for t in terms_of_word(w)], np.int64))


class FactorizationMachine:
    """bias + sum of weights + sum over pairs of inner products, of the terms present, through a logistic link.

    Every term of LEAST_DOCS learning rows has a weight and factors, so that pairs without an effect of their own count.
    Weights start at the log odds ratio, shrunk by what chance gives the largest of so many terms; factors start near zero.
    A document's step is shared among its terms, so that long texts do not gather noise.
    """

    def __init__(self, docs: list[np.ndarray], y: np.ndarray):
        rng, y = np.random.default_rng(SEED), np.asarray(y, float)
        flat = np.concatenate([*docs, np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        df = np.bincount(flat, minlength=SPACE)
        dp = np.bincount(flat, weights=y[row], minlength=SPACE)
        n, p = max(len(docs), 1), float(y.sum())
        a, b = dp / max(p, 1), (df - dp) / max(n - p, 1)
        pooled = df / n
        z = np.abs(a - b) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / max(p, 1) + 1 / max(n - p, 1)))
        self.term = np.flatnonzero(df >= LEAST_DOCS)
        chance = 2 * np.log(max(len(self.term), 2))
        odds = np.log((dp + 0.5) / (p + 1)) - np.log((df - dp + 0.5) / (n - p + 1))
        kept = np.maximum(0, 1 - chance / np.maximum(z[self.term] ** 2, 1e-12))
        self.weight, self.factor = kept * odds[self.term], rng.normal(0, 0.01, (len(self.term), FACTORS))
        self.bias = float(np.log((p + 1) / (n - p + 1)))
        slot = np.full(SPACE, -1)
        slot[self.term] = np.arange(len(self.term))
        active = [s[s >= 0] for s in (slot[d] for d in docs)]
        gw, gv, gb = np.full(len(self.term), HELD_BACK), np.full(self.factor.shape, HELD_BACK), 1e-6
        for _ in range(EPOCHS):
            for i in rng.permutation(len(docs)):
                x = active[i]
                v = self.factor[x]
                total = v.sum(0)
                g = 1 / (1 + np.exp(-np.clip(self.bias + self.weight[x].sum() + 0.5 * (total @ total - (v * v).sum()), -30, 30))) - y[i]
                if abs(g) < SETTLED:
                    continue
                gb += g * g
                self.bias -= RATE * g / np.sqrt(gb)
                own = g / max(len(x), 1) ** 0.5
                dw, dv = own + DECAY * self.weight[x], own * (total - v) + DECAY * v
                gw[x] += dw * dw
                gv[x] += dv * dv
                self.weight[x] -= RATE * dw / np.sqrt(gw[x])
                self.factor[x] -= RATE * dv / np.sqrt(gv[x])

    def score(self, slots: np.ndarray) -> float:
        v = self.factor[slots]
        total = v.sum(0)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[slots].sum() + 0.5 * (total @ total - (v * v).sum()), -30, 30))))


class Scorer:
    """Scores texts; the terms of a distinct word are looked up once while it remembers them."""

    def __init__(self, model: FactorizationMachine):
        self.model, self.slot = model, dict(zip(model.term.tolist(), range(len(model.term)), strict=True))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.slots: list[tuple[int, ...]] = []

    def score(self, text: str) -> float:
        if len(self.number) > KEPT_WORDS:
            self.forget()
        words = WORD.findall(text.lower())
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > len(self.slots):
            new = list(self.number)[len(self.slots) :] if len(self.number) - len(self.slots) > 2000 else [w for w in dict.fromkeys(words) if self.number[w] >= len(self.slots)]
            self.slots += [tuple(s for t in terms_of_word(w) if (s := self.slot.get(t)) is not None) for w in new]
        there = {s for i in set(at.tolist()) for s in self.slots[i]}
        return self.model.score(np.array(sorted(there), np.int64))


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> FactorizationMachine:
    """A machine learnt from at most `limit` labelled rows, half of them toxic where there are enough.

    Terms are hashed on the executors; the driver gets the distinct term numbers of the bounded sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.tolist() for d in found], pa.list_(pa.int64())), batch.column(2)], names=["_id", "terms", "y"])

    toxic = learning_rows(docs, labels.where("toxic = 1"), "toxic", limit // 2)
    clean = learning_rows(docs, labels.where("toxic = 0"), "toxic", limit - limit // 2)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = toxic.union(clean).mapInArrow(run, f"_id {kind}, terms array<long>, y int")
    return FactorizationMachine(*sample_to_driver(sample, "terms"))


def toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) with held_out, score and predicted; one row per row, other columns dropped.

    Null and empty texts score as texts without terms; repeated rows score alike. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the term space

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(x.as_py() or "") for x in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity; learnt from labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, read(spark, sf_dir, "labels")))
