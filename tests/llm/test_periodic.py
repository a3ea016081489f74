import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from conftest import DATA

from plumbline.llm import periodic
from plumbline.llm.common import read
from plumbline.llm.queries import QUERIES


def slow_runs(words):
    """Every run by trying each lag on the whole text, and each shorter period of what is found."""
    _, w = np.unique(np.array(words or ["x"], dtype=object), return_inverse=True)
    w, out = w[: len(words)], []
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate(([0], (w[q:] == w[:-q]).astype(np.int8), [0]))
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            n = int(b - a) + q
            if n >= max(24, 3 * q) and not any((w[a : a + n - d] == w[a + d : a + n]).all() for d in range(1, q)):
                out.append((int(a), n, q))
    return sorted(out)


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_text(rng):
    letters, n = rng.choice([1, 2, 3, 50]), rng.randrange(300)
    few = lambda most: [str(rng.randrange(letters)) for _ in range(rng.randrange(1, most))]
    kind = rng.randrange(5)
    if kind == 0:
        return few(n + 2)
    if kind == 1:
        unit = few(60)
        return few(20) + unit * rng.randrange(2, 6) + unit[: rng.randrange(len(unit))] + few(20)
    if kind == 2:  # a period of periods
        parts = [few(25) for _ in range(3)]
        unit = sum((rng.choice(parts) for _ in range(rng.randrange(1, 9))), [])
        return unit * rng.randrange(2, 5) + unit[: rng.randrange(len(unit) + 1)]
    if kind == 3:  # Fibonacci words: the most runs for their length
        a, b = ["a"], ["a", "b"]
        while len(b) <= n:
            a, b = b, b + a
        return b[:n]
    x, y = ([f"{c}{i}" for i in range(rng.randrange(8, 24))] for c in "xy")
    unit = sum(((x, y)[c] for c in (0, 0, 0, 1, 1, 1, 0, 1)), [])  # each pair of parts occurs twice in the period
    return unit * 3 + unit[: rng.randrange(len(unit))]


def test_runs_equal_every_lag_tried():
    for seed in range(25):
        rng = random.Random(seed)
        texts = [some_text(rng) for _ in range(10)]
        _, runs, left = periodic.search(pa.array([" ".join(t) for t in texts]))
        for t, found, text in zip(texts, runs.to_pylist(), left.to_pylist(), strict=True):
            want = slow_runs(t)
            assert [(r["start"], r["length"], r["period"]) for r in found] == want and text == collapsed(t, want)


def test_long_texts_and_large_alphabets():
    rng = np.random.default_rng(3)
    unit = [str(x) for x in rng.integers(0, 1 << 40, 70_000)]
    _, runs, left = periodic.search(pa.array([" ".join(["a", *(unit * 3), "b"]), "x " * 400_000]))
    assert runs.to_pylist() == [[{"start": 1, "length": 210_000, "period": 70_000}], [{"start": 0, "length": 400_000, "period": 1}]]
    assert left.to_pylist()[0].count(" ") == 70_001 and left.to_pylist()[1] == "x"


def test_large_numbers_are_sorted_another_way():
    a, b = np.array([5, 5, 1 << 40, 5], np.int64), np.array([1 << 40, 2, 0, 2], np.int64)
    order, new = periodic._ordered(a, b)
    assert order.tolist() == [1, 3, 0, 2] and new.tolist() == [True, False, True, True]


def spec(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapsed(words, runs)))


def test_query_equals_its_rule(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    got = {tuple(r) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert got == {spec(*d) for d in docs} and sum(r[1] for r in got) > 5


def test_odd_rows(spark):
    spaces = "\x1c\x85 a\x0b\x0ca a"  # of these only space, vertical tab and form feed part words
    given = [(None, None, "r"), (None, "a " * 30, "r"), (1, "", "r"), (2, " \t\n", "r"), (3, "b a " * 12, "r"), (3, "b a " * 12, "r"), (4, spaces, "r")]
    docs = spark.createDataFrame(given, "doc_id long, text string, runs string")
    found = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect())
    assert found == sorted([("None", 0, [], ""), ("None", 30, [(0, 30, 1)], "a"), ("1", 0, [], ""), ("2", 0, [], ""), *[("3", 24, [(0, 24, 2)], "b a")] * 2, ("4", 3, [], "\x1c\x85 a a a")])
    assert periodic.periodic_runs(docs.where("doc_id = 9")).count() == 0
    assert periodic.planted(docs).count() == len(given)
