"""Deduplication, mixing and their edge cases, against brute force."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA, rows
from pyspark.sql import functions as F

from plumbline.llm import components, exact_dedup, mixing, near_texts, neardup_vectors, simhash
from plumbline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string"
EDGES = [
    (1, "a b c", "en", "s", 5, "x", "y"), (2, "abc", "en", "s", 3, "x", "y"), (None, " a bc", None, None, 5, None, None), (4, None, "en", "s", 0, "x", "y"), (5, "", "en", "t", 0, "x", "y"),
    (5, "", "en", "t", 0, "x", "y"), (6, "\t \n", "en", None, 3, "x", "y"), (7, "word " * 40_000, "en", "t", 1, "x", "y"), (8, "word " * 40_000 + "end", "en", "t", 1, "x", "y"), (9, "A b C", "en", "s", 5, "x", "y"), (9, "word" * 40_000, "fr", "s", 5, "x", "y"),
]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, found = QUERIES[name](spark, DATA), duck.execute(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


def closed(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    df = spark.createDataFrame([*chain, (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.components(df).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert components.components(df.where("a > 1000")).count() == 0


def test_exact_groups_edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(list)
    for r in EDGES:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(map(str, best)) == sorted(str(tuple(r)) for r in kept.collect())
    assert exact_dedup.without_copies(docs.where("doc_id > 100")).count() == 0


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_edges(spark):
    docs = spark.createDataFrame([*EDGES, (20, "ÀB c D é", "", "", 1, "", "")], SCHEMA)
    found = simhash.simhash_groups(docs).collect()
    want = sorted((str(r[0]), f"{brute_fingerprint(r[1]):016x}") for r in docs.collect())
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == want
    assert {r.component_id for r in found if r.fingerprint == "0" * 16} == {4}
    assert simhash.simhash_groups(docs.where("doc_id > 100")).count() == 0


def test_golay_keys_lose_no_pair():
    rng = np.random.default_rng(3)
    upper, errors = simhash.golay_tables()
    assert len(set(errors.tolist())) == 2048 and max(bin(e).count("1") for e in errors.tolist()) == 3
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 3, replace=False)) for k in range(3000)], np.uint64)
    one, other = defaultdict(set), defaultdict(set)
    for keys, fp in ((one, a), (other, a ^ flips)):
        for row, key in zip(*simhash.fuzzy_keys(fp.view(np.int64)), strict=True):
            keys[int(row)].add(int(key))
    assert all(one[i] & other[i] for i in range(3000))


@pytest.mark.parametrize("held", [20_000, 10])
def test_simhash_links_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD", held)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for _ in range(500)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    label = closed(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.component for r in components.components(simhash.near_links(df)).collect()}
    groups = defaultdict(set)
    for x, k in zip(signed, label, strict=True):
        groups[k].add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in found if found[n] == c) for c in set(found.values())}
    if held == 10:  # the bucket function on its own
        a, b = simhash.links_of_bucket(np.array(signed, np.int64))
        local = closed(len(fps), [(signed.index(x), signed.index(y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        assert len(set(local)) == len(set(label))


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"]
    return words


@pytest.mark.parametrize("few", [32, 3])
def test_near_texts_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(near_texts, "FEW", few)
    rng = random.Random(9)
    word = lambda: f"w{min(rng.randrange(3000), rng.randrange(3000))}"
    base = [[word() for _ in range(rng.choice((12, 80, 300)))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join(edited(rng, base[k % 20], rng.randrange(1, 2 + len(base[k % 20]) // 30))) for k in range(150)]
    texts += [" ".join(edited(rng, base[21], rng.randrange(1, 5))) for _ in range(120)] + [texts[3].upper(), "a b", "A  b", "", None, " \n", "b a"]
    docs = spark.createDataFrame([(1000 - i if i else None, t, "r", "a") for i, t in enumerate(texts)], "doc_id long, text string, row string, a string")
    sets = [shingle_set(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = closed(len(texts), near)
    kept = near_texts.without_near_copies(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id for r in kept.collect()}
    groups = defaultdict(list)
    for i, k in enumerate(label):
        groups[k].append(1000 - i if i else None)
    stays = {min(g, key=lambda x: (x is None, x or 0)) for g in groups.values()}
    assert stays <= found and len(found - stays) <= 0.05 * (len(texts) - len(stays))
    assert near_texts.without_near_copies(docs.where("doc_id > 5000")).count() == 0


def rows_of_joins(spark, work):
    """The most rows that a join made while work ran, from Spark's own metrics."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {found.apply(i).executionId() for found in [store.executionsList()] for i in range(found.size())}
    before, result, most = ids(), work(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    for k in ids() - before:
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for m in range(metrics.size()) if "Join" in nodes.apply(j).name() else ():
                if metrics.apply(m).name() == "number of output rows" and (v := values.get(metrics.apply(m).accumulatorId())).isDefined():
                    most = max(most, int(v.get().replace(",", "")))
    return result, most


def test_near_texts_of_look_alikes(spark):
    """Texts that all share buckets but are near copies of few others: their groups are those of all pairs, and no join makes a row for each pair."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(edited(rng, base, rng.randrange(4, 9))) for _ in range(500)]
    sets = [shingle_set(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = closed(len(texts), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, most = rows_of_joins(spark, lambda: {r.doc_id for r in near_texts.without_near_copies(docs).collect()})
    assert 50 < len(set(label)) < 450
    assert kept == {min(i for i, k in enumerate(label) if k == c) for c in set(label)}
    assert most < 200 * len(texts)  # a row has so many keys at most; a join of pairs by key made 3,113,202


@pytest.mark.parametrize("columns", [4096, 7])
def test_tile_links(monkeypatch, columns):
    """Links of a tile join what all its pairs join; rows of one component need none."""
    monkeypatch.setattr(near_texts, "COLUMNS", columns)
    rng = random.Random(6)
    sets = [[], [5], [5]] + [sorted(set(range(40)) ^ set(rng.sample(range(60), rng.randrange(6)))) for _ in range(60)]
    of = [rng.choice((900, k)) for k in range(len(sets))]
    rows = [1000 - k for k in range(len(sets))]
    found = near_texts.tile_links(pa.table({"row": rows, "component": of, "h": pa.array(sets, pa.list_(pa.int64()))})).to_pylist()
    near = {(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(set(sets[i]) & set(sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    at = {r: i for i, r in enumerate(rows)}
    links = [(max(p), min(p)) for p in ((at[x["a"]], at[x["b"]]) for x in found)]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if of[i] == of[j]]
    assert all(x["a"] < x["b"] for x in found) and set(links) <= near - set(alike) and len(links) < len(sets)
    assert closed(len(sets), links + alike) == closed(len(sets), [*near, *alike])


def test_near_texts_of_a_table(spark):
    """Planted near copies of sf0.01 against all pairs that share a rare shingle."""
    docs = exact_dedup.without_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    holders = defaultdict(list)
    for i, found in texts.items():
        for x in found:
            holders[x].append(i)
    pairs = {(a, b) for g in holders.values() if len(g) < 50 for a in g for b in g if a < b}
    near = {(a, b) for a, b in pairs if 5 * len(texts[a] & texts[b]) >= 4 * len(texts[a] | texts[b])}
    dropped = set(texts) - {r.doc_id for r in near_texts.without_near_copies(docs).collect()}
    assert dropped <= {max(p) for p in near} and len(dropped) >= 0.9 * len(near) > 0


def test_vectors_with_many_planes(spark, monkeypatch):
    """Small buckets make many planes and tables; the recall holds."""
    monkeypatch.setattr(neardup_vectors, "BUCKET", 1)
    rng = np.random.default_rng(6)
    center = rng.standard_normal((200, 24))
    x = np.concatenate([center, center + 0.3 * rng.standard_normal(center.shape), center + 0.42 * rng.standard_normal(center.shape)])
    planes, tables = neardup_vectors.shape_of_tables(len(x))
    assert planes >= 10 and tables > 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = y @ y.T >= 0.9
    np.fill_diagonal(close, False)
    got = np.array([r.n_links for r in neardup_vectors.vector_groups(df).orderBy("vec_id").collect()])
    assert (got <= close.sum(1)).all() and got.sum() >= 0.9 * close.sum() > 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    center = rng.standard_normal((12, 16))
    x = np.concatenate([center[i % 12] + 0.12 * rng.standard_normal(16) for i in range(300)]).reshape(300, 16).astype(np.float32)
    x[5] = x[6] = x[7]
    rows_ = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [], 1), (305, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in neardup_vectors.vector_groups(df).collect()}
    y = np.concatenate((x, x[:1])).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = y @ y.T >= 0.9
    np.fill_diagonal(close, False)
    want = close.sum(1)
    got = np.array([found[i].n_links for i in [*range(300), None]])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    label = closed(301, list(zip(*np.nonzero(close), strict=True)))
    assert [found[i].component_id for i in range(300)] == label[:300]
    assert found[None].component_id == 0 and not found[None].kept
    for i in range(300, 306):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert neardup_vectors.vector_groups(df.where("vec_id > 1000")).count() == 0


def test_mix_edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    out = mixing.mixed(docs).toPandas()
    assert len(out) == len(EDGES) and (out.taken <= 3 * out["size"]).all()
    assert abs(out.groupby(out.source.fillna("~")).target.first().sum() - out["size"].sum()) < 1e-6
    many = mixing.mixed_documents(docs)
    assert many.columns == docs.columns
    assert many.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == out.taken.sum()
    assert mixing.mixed(docs.where("doc_id > 100")).count() == 0
    again = mixing.mixed(docs.repartition(3)).toPandas()
    assert sorted(again.taken) == sorted(out.taken)


def test_mix_inclusion_follows_its_probability(spark):
    """Many sources with the same documents and other random numbers: how often each is taken."""
    rng = np.random.default_rng(4)
    sizes, runs = [3, 9, 20, 60, 130, 300, 700, 1500] * 150, 30
    made = [(f"s{k:03}", float(s), i, float(rng.random())) for k in range(runs) for i, s in enumerate(sizes)]
    rows_ = spark.createDataFrame(made, "source string, s double, item int, u double").select("source", F.col("s").cast("long").alias("size"), "item", "u")
    decisions = mixing.decide(rows_, weights=(1,))
    out = mixing.copies_of(rows_, decisions)
    found = {r.item: r.copies for r in out.groupBy("item").agg(F.avg("copies").alias("copies")).collect()}
    level = decisions.first().level
    want = np.array([min(3.0, level * len(f"{s:b}")) for s in sizes])
    assert len(set(want.round(6))) == 8 and want.min() < 0.3 and want.max() > 1.0
    got = np.array([found[i] for i in range(len(sizes))])
    assert abs(got.reshape(-1, 8).mean(0) - want[:8]).max() < 0.03
    total = [r.total for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("total")).collect()]
    assert max(total) <= sum(sizes) and np.mean(total) > 0.995 * sum(sizes)


def test_mix_one_very_long_document(spark):
    """A document that blocks leaves no gap: those behind it that fit are taken."""
    rng = np.random.default_rng(5)
    made = [(f"s{k:02}", int(s), float(rng.random())) for k in range(12) for s in [*rng.integers(50, 400, 800), 200_000]]
    rows_ = spark.createDataFrame(made, "source string, size long, u double")
    out = mixing.copies_of(rows_, mixing.decide(rows_, weights=(1,))).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    gap = [1 - r.taken / r.target for r in out]
    assert min(gap) >= 0 and np.median(gap) < 0.0011


def test_digest_is_of_normalised_text(spark):
    docs = spark.createDataFrame([(1, " a\x0bb\r\n")], "doc_id long, text string").withColumn("row", F.lit(1).cast("long"))
    assert exact_dedup.exact_groups(docs).first().text_sha256 == sha256(b"ab").hexdigest()
