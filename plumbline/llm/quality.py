"""Operator 4: quality by supervised subword embeddings."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, learning_rows, read, sample_to_driver

#: Hashed features; the last one counts words that repeat the word before them.
BUCKETS = 1 << 17
REPEAT = BUCKETS
GRAM = 3
DIM, EPOCHS, RATE, SEED = 12, 12, 0.3, 5
#: At most so many labelled documents are learnt from, half of each label where there are enough.
LEARN_ROWS = 4_000
THRESHOLD = 0.5
#: A task forgets its distinct words beyond so many. Words longer than LONG are not remembered; their grams are counted in chunks.
KEPT_WORDS, LONG, CHUNK = 300_000, 200, 1 << 16


def features_of_word(word: str) -> dict[int, int]:
    """Hashed features and how often each is there: the word in brackets and its character n-grams; case and punctuation stay."""
    raw = f"<{word}>"
    count: dict[int, int] = {}
    if len(word) <= LONG:
        for g in (raw, *(raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1))):
            f = crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS
            count[f] = count.get(f, 0) + 1
        return count
    count[crc32(raw.encode("utf-8", "surrogatepass")) % BUCKETS] = 1
    for k in range(0, len(raw) - GRAM + 1, CHUNK):
        code = np.frombuffer(raw[k : k + CHUNK + GRAM - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        gram, n = np.unique(sum(code[i : len(code) - GRAM + 1 + i] << 21 * i for i in range(GRAM)), return_counts=True)
        for g, m in zip(gram.tolist(), n.tolist(), strict=True):
            f = crc32("".join(chr(g >> 21 * i & 0x1FFFFF) for i in range(GRAM)).encode("utf-8", "surrogatepass")) % BUCKETS
            count[f] = count.get(f, 0) + m
    return count


def repeats(words: list[str]) -> int:
    return sum(map(str.__eq__, words, words[1:]))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct features, share of each among all features of the text)."""
    words = text.split()
    count: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for f, m in features_of_word(word).items():
            count[f] += n * m
    if n := repeats(words):
        count[REPEAT] += n * GRAM
    ids = np.array(sorted(count), np.int64)
    share = np.array([count[i] for i in ids.tolist()], np.float64)
    return ids, share / max(share.sum(), 1)


class SubwordClassifier:
    """Vectors of hashed features, averaged over a document, with a softmax output; stochastic gradient descent."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, learnt: dict[str, np.ndarray] | None = None):
        """learnt, if given, takes the vectors, the output and its bias."""
        rng = np.random.default_rng(SEED)
        vector, output, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)), np.zeros((2, DIM)), np.zeros(2)
        used = np.zeros(BUCKETS + 1, bool)
        for ids, _ in docs:
            used[ids] = True
        vector[~used] = 0  # what was never seen says nothing
        steps, done = EPOCHS * max(len(docs), 1), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(docs)):
                ids, share = docs[i]
                rate = RATE * (1 - done / steps)
                done += 1
                hidden = share @ vector[ids]
                logit = output @ hidden + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[int(y[i])] -= 1
                back = p @ output
                output -= rate * np.outer(p, hidden)
                bias -= 0.1 * rate * p
                vector[ids] -= rate * np.outer(share * len(ids) ** 0.5, back)
        #: The output is linear in the average, so each feature needs one number only.
        self.worth = (vector @ (output[1] - output[0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        if learnt is not None:
            learnt |= {"vector": vector, "output": output, "bias": bias}


class Scorer:
    """Scores texts; a distinct word is hashed once while it is remembered."""

    def __init__(self, model: SubwordClassifier):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.worth, self.many = np.zeros(1024), np.zeros(1024)
        self.known = 0

    def score(self, text: str) -> float:
        if len(self.number) > KEPT_WORDS:
            self.forget()
        every = text.split()
        words = [w for w in every if len(w) <= LONG]
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > self.known:
            new = list(dict.fromkeys(w for w, i in zip(words, at.tolist(), strict=True) if i >= self.known))
            found = [features_of_word(w) for w in new]
            starts = np.cumsum([0, *map(len, found)])[:-1]
            times = np.array([m for f in found for m in f.values()])
            sums = np.add.reduceat(self.model.worth[np.array([i for f in found for i in f])].astype(float) * times, starts)
            sizes = np.add.reduceat(times, starts)
            while len(self.number) > len(self.worth):
                self.worth, self.many = (np.concatenate((x, np.zeros(len(x)))) for x in (self.worth, self.many))
            self.worth[self.known : self.known + len(new)], self.many[self.known : self.known + len(new)] = sums, sizes
            self.known += len(new)
        worth, many = self.worth[at].sum(), self.many[at].sum()
        if len(every) > len(words):
            for word, n in Counter(w for w in every if len(w) > LONG).items():
                f = features_of_word(word)
                times = n * np.fromiter(f.values(), np.int64, len(f))
                worth, many = worth + self.model.worth[np.fromiter(f, np.int64, len(f))].astype(float) @ times, many + times.sum()
        same = (repeats(every) if len(every) > len(words) else int((at[1:] == at[:-1]).sum())) * GRAM
        total = many + same
        logit = self.model.bias + ((worth + same * float(self.model.worth[REPEAT])) / total if total else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> SubwordClassifier:
    """A classifier learnt from at most `limit` labelled rows, half of each label where there are enough.

    Texts are hashed on the executors; the driver gets the distinct features of the bounded sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([b.tolist() for _, b in found], pa.list_(pa.float32())), batch.column(2)], names=["_id", "ids", "share", "y"]
            )

    parts = [learning_rows(docs, labels.where(f"quality = {k}"), "quality", limit // 2) for k in (0, 1)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = parts[0].union(parts[1]).mapInArrow(run, f"_id {kind}, ids array<int>, share array<float>, y int")
    ids, share, y = sample_to_driver(sample, "ids", "share")
    return SubwordClassifier(list(zip(ids, share, strict=True)), y)


def scored(docs: DataFrame, model: SubwordClassifier) -> DataFrame:
    """docs with a column score (0 to 1), in place of one of that name; null and empty texts score as texts without words, repeated
    rows alike; an empty table gives an empty one. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for column in texts:
            yield pa.array([scorer.score(x.as_py() or "") for x in column], pa.float64())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col("text")))


def quality(docs: DataFrame, model: SubwordClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text); repeated rows score alike."""
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier learnt from labels accepts, with the columns of docs whatever their names; repeated rows stay
    repeated, null and empty texts are judged as texts without words, an empty table gives an empty one."""
    model = learn(docs, labels)
    return scored(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model).where(F.col("score") >= threshold).select("doc.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality; learnt from labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return quality(docs, learn(docs, read(spark, sf_dir, "labels")))
